"""Default stop-word list.

One explicit list, used as given by the Spark plans and inlined by the SQL
oracles; callers pass their own list to replace it.
"""

from __future__ import annotations

# Common function words of four languages.
DEFAULT_STOPWORDS = {
    "english": (
        "a an and are as at be but by for from had has have he her his i if in is it its my no not of on or our "
        "she so that the their them they this to was we were which will with you your"
    ),
    "french": (
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas "
        "pour qui que sa se ses son sur un une vous"
    ),
    "german": (
        "aber als auch auf aus bei das dem den der des die ein eine einer er es für hat ich im ist mit nach nicht "
        "sich sie sind und von war wie wir zu zum"
    ),
    "spanish": (
        "al como con del el ella en entre es esta este la las lo los más no nos para pero por que se si sin su "
        "sus un una y ya"
    ),
}
DEFAULT_LANGS = tuple(DEFAULT_STOPWORDS)


def default_stopwords(langs=DEFAULT_LANGS) -> list[str]:
    return sorted({w for lang in langs for w in DEFAULT_STOPWORDS[lang].split()})


def load_default_stopwords(spark, langs=DEFAULT_LANGS) -> list[str]:
    """The default list; ``spark`` is accepted so that loaders of stored lists share the signature."""
    return default_stopwords(langs)
