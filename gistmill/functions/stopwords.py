"""Stop-word lists, taken as parameters by every operator that needs one."""

from __future__ import annotations

# The public lists that ship with Spark ML's StopWordsRemover.
DANISH = tuple(
    """
og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi
min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her
alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette
mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos
blive mange ad bliver hendes været thi jer sådan
""".split()
)

ENGLISH = tuple(
    """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now i'll you'll
he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split()
)

LISTS = {"da": DANISH, "en": ENGLISH}


def stop_words(lang: str) -> tuple[str, ...]:
    """The list for a language code; unknown codes are an error, not a guess."""
    if lang not in LISTS:
        raise ValueError(f"no stop words for {lang!r}: pass a list instead")
    return LISTS[lang]
