"""Text expressions: tokens, n-grams, pairs, term and phrase rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product token pattern (Unicode word boundaries) and one that any engine reads alike.
TOKEN_PATTERN = r"\b[a-zA-Z][a-zA-Z0-9\-]{1,}\b"
PORTABLE_PATTERN = "[a-z][a-z0-9]+"

# Word lists that results depend on.
ENGLISH_STOPWORDS = tuple("a about above across after again against all almost along already also although always am among an and another any are around as at back be because been before behind being below between beyond both but by can could did do does doing during each either even every except few for from further had has have having he her here him himself his how however i if in instead into is it its itself just may me might more most mostly much must my never next no nor not now of off often on once one only onto or other others our out over own per perhaps rather same see she should since so some still such than that the their them themselves then there these they this those though through thus to too towards under unless until up upon us very was we were what whatever when where which while who whom whose why will with within without would yet you your".split())
GENERIC_TERMS = tuple("analysis approach article data effect example method model paper problem proof research result study".split())
RHETORICAL_TERMS = tuple("answer answers application applications case cases certain construct construction existence extend extension general give gives new note obtain paper present prove proved proves proving question questions related remark remarks similar show showing shows theorem theorems version we".split())
MATH_SYMBOLS = tuple("c g h k l n p q r x".split())
FORMULA_TERMS = tuple("mathbf mathbb mathrm operatorname text".split())
LOW_SIGNAL_TERMS = tuple("absolute conjecture curves function functions groups random space special stable times universal varieties".split())
PHRASE_MARKUP_TERMS = tuple("annotation display inline math mathjax mathml mfrac mi mml mn mo mrow msqrt msub msubsup msup semantics xmlns".split())
TERM_MARKUP_TERMS = tuple("accent annotation display false http inline math mathml mathvariant mathjax mi mn mo mover mprescripts mrow msub msup msubsup mfrac mstyle msqrt mml mmultiscripts mtext none normal org semantics stretchy w3 www xmlns".split())
BIBLIOMETRIC_TERMS = tuple("abstract analysis article articles based conclusion data findings method methods paper papers publication publications research researchers result results science scientific study studies using".split())
# End of fixed values.


def literals(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokens(text: Column, pattern: str = TOKEN_PATTERN, stopwords: tuple[str, ...] = ENGLISH_STOPWORDS) -> Column:
    """Lower-cased tokens without stop words (which go before n-grams are made)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stopwords)) if stopwords else found


def ngrams(words: Column, least: int = 1, most: int = 2) -> Column:
    """Contiguous n-grams, shorter ones first, joined by a space.

    Longer grams are made from shorter ones by zipping shifted arrays: the token expression is not evaluated for each place.
    """
    if not 1 <= least <= most <= 5:
        raise ValueError("n-gram bounds must satisfy 1 <= least <= most <= 5")
    made, out = words, [words] if least == 1 else []
    for n in range(2, most + 1):
        shifted = F.slice(words, n, F.greatest(F.size(words) - n + 1, F.lit(0)))
        made = F.filter(F.zip_with(made, shifted, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
        if n >= least:
            out.append(made)
    return out[0] if len(out) == 1 else F.concat(*out)


def pairs(items: Column) -> Column:
    """Unordered pairs of a sorted array's elements, as structs ``source`` and ``target``."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("source"), y.alias("target")))))


def clean_term(term: Column) -> Column:
    """Co-word term: lower case, tags out, ``[a-z0-9 -]`` only. Runs of spaces inside stay, as results depend on it."""
    value = F.regexp_replace(F.regexp_replace(F.lower(term), "<[^>]+>", " "), "[^a-z0-9 -]+", " ")
    return F.regexp_replace(value, "^[ -]+|[ -]+$", "")


def is_low_signal(term: Column) -> Column:
    """Terms whose words are all short, that hold markup words, or are bibliometric commonplaces."""
    words = F.filter(F.split(term, r"[\s-]+"), lambda w: w != "")
    return (
        (F.size(words) == 0)
        | F.forall(words, lambda w: F.length(w) <= 2)
        | F.exists(words, lambda w: w.isin(*TERM_MARKUP_TERMS))
        | F.forall(words, lambda w: w.isin(*BIBLIOMETRIC_TERMS))
    )


def clean_phrase(text: Column) -> Column:
    """Keyphrase form. Accents are decomposed by ``functions.udfs.nfkd_udf`` before, where texts have any."""
    value = F.regexp_replace(F.lower(text), "<[^>]+>", " ")
    value = F.regexp_replace(F.regexp_replace(value, r"[\\/]", " "), r"[-‐‑‒–—]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(value, "[^a-z0-9 ]+", " "), r"\s+", " "))


def is_weak_phrase(phrase: Column, custom: tuple[str, ...] = ()) -> Column:
    """Phrases that can't stand for a topic."""
    words = F.filter(F.split(phrase, " "), lambda w: w != "")
    n, first, last = F.size(words), F.get(words, 0), F.element_at(words, -1)
    stop = tuple(dict.fromkeys((*ENGLISH_STOPWORDS, *custom, *GENERIC_TERMS)))
    some = lambda names: F.exists(words, lambda w: w.isin(*names))
    lone_letter = F.exists(words, lambda w: (F.length(w) == 1) & ~w.isin(*MATH_SYMBOLS))
    weak = (n > 6) | first.isin(*stop) | last.isin(*stop) | some(RHETORICAL_TERMS) | some(ENGLISH_STOPWORDS) | (first == "s")
    weak = weak | ((n == 2) & lone_letter) | ((n == 1) & ((F.length(first) < 4) | first.isin(*LOW_SIGNAL_TERMS))) | some(PHRASE_MARKUP_TERMS) | some(FORMULA_TERMS)
    return (n == 0) | F.coalesce(weak, F.lit(True))


def phrase_quality(term: Column) -> Column:
    n = F.size(F.split(term, " "))
    return F.when(term == "", F.lit(0.0)).when(n == 1, 0.92).when(n == 2, 1.0).when(n == 3, 0.94).when(n == 4, 0.82).otherwise(0.65)
