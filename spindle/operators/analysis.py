"""The analyzer: from a text to its terms, in one row and without Python.

Index and query side are the same expressions; only code prefixes depend on the mode. Packs apply in order of priority, and
where two make the same term of a field at a position the first one's kind stays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Versions that enter the configuration's hash.
TOKENIZER_VERSION, FOLDER_VERSION = "tok-1", "fold-1"
_VARIANTS = "array<struct<term:string,field:string,kind:string>>"


def _variants(terms: Column, name: str, kind: str) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(name).alias("field"), F.lit(kind).alias("kind")))


def _no_variants() -> Column:
    return F.array().cast(_VARIANTS)


@dataclass(frozen=True)
class Pack:
    """A language or code pack: which classes it claims, what it makes of a token (struct lower, class, vi, latin), and which
    lower-cased words it holds for stopwords; `bigrams` lets pairs of tokens that it claims be phrases."""

    id: str
    priority: int
    classes: tuple[str, ...] | None
    signature: str
    variants: Callable[[Column, str], Column]
    stopwords: tuple[str, ...] = ()
    bigrams: bool = False
    makes: bool = True  # a pack of stopwords alone makes no terms
    fields: tuple[str, ...] | None = None  # the fields besides text in which each token that it claims has a term, and it no other has; None: unknown
    needs: Callable[[Column], Column] = lambda t: F.lit(True)  # false only for tokens of which it makes nothing

    def claims(self, kind: Column) -> Column:
        return F.lit(True) if self.classes is None else kind.isin(*self.classes)


def code_pack(min_prefix: int = 2) -> Pack:
    """Whole codes, their runs of digits and letters and, on the index side, their prefixes."""

    def variants(t: Column, mode: str) -> Column:
        lower = t["lower"]
        digits = F.array_except(F.regexp_extract_all(lower, F.lit("[0-9]{2,}"), F.lit(0)), F.array(lower))
        letters = F.array_except(F.regexp_extract_all(lower, F.lit("[a-z]{2,}"), F.lit(0)), F.array(lower))
        made = [_variants(F.array(lower), "code", "code_exact"), _variants(digits, "code", "code_digits"), _variants(letters, "code", "code_letters")]
        if mode == "index":
            steps = F.when(F.length(lower) > min_prefix, F.sequence(F.lit(min_prefix), F.length(lower) - 1)).otherwise(F.array().cast("array<int>"))
            prefixes = F.array_except(F.transform(steps, lambda i: F.substring(lower, F.lit(1), i)), F.concat(F.array(lower), digits, letters))
            made.append(_variants(prefixes, "code", "code_prefix"))
        return F.concat(*made)

    return Pack("code", 10, ("ALNUM_CODE", "NUMERIC_UNIT"), f"code-2:minPrefix={min_prefix}", variants, fields=("code",))


def _folded(name: str) -> Callable[[Column, str], Column]:
    return lambda t, _: F.when(_differs(name)(t), _variants(F.array(t[name]), "text", "fold")).otherwise(_no_variants())


def _differs(name: str) -> Callable[[Column], Column]:
    return lambda t: (t[name] != "") & (t[name] != t["lower"])


def vietnamese_pack() -> Pack:
    return Pack("vi", 20, ("WORD_DIACRITIC",), f"vi-1:{FOLDER_VERSION}:sw{len(T.VIETNAMESE_STOPWORDS)}", _folded("vi"), T.VIETNAMESE_STOPWORDS, bigrams=True, fields=(), needs=_differs("vi"))


def english_pack(stem: bool = False) -> Pack:
    return Pack("en", 30, ("WORD_LATIN",), f"en-1:stem={int(stem)}", lambda t, _: _no_variants(), T.ENGLISH_STOPWORDS, makes=False)


def generic_pack() -> Pack:
    return Pack("generic", 90, None, f"generic-1:{FOLDER_VERSION}", _folded("latin"), fields=(), needs=_differs("latin"))


@dataclass(frozen=True)
class AnalyzerConfig:
    packs: tuple[Pack, ...] = field(default_factory=lambda: (code_pack(), vietnamese_pack(), english_pack(), generic_pack()))
    bigrams: bool = True

    def ordered(self) -> list[Pack]:
        return sorted(self.packs, key=lambda p: p.priority)

    def hash(self) -> str:
        """16 hex digits that change with the packs, their versions and options."""
        options = {"bigrams": self.bigrams}
        shape = {"packs": [f"{p.id}@{p.priority}#{p.signature}" for p in self.ordered()], "tokenizer": TOKENIZER_VERSION, "folder": FOLDER_VERSION, "options": options}
        return hashlib.sha256(json.dumps(shape, ensure_ascii=False, separators=(",", ":")).replace("/", "\\/").encode()).hexdigest()[:16]

    def fields(self) -> list[str]:
        """The fields besides text, whose terms go to zones of those names."""
        return sorted({f for p in self.packs if p.makes for f in p.fields or ()} | ({"phrase"} if self.pairing() else set()))

    def known(self) -> bool:
        """Whether all packs name the fields that they make terms of."""
        return all(p.fields is not None for p in self.packs if p.makes)

    def pairing(self) -> list[Pack]:
        """The packs whose tokens make phrases."""
        return [p for p in self.packs if p.bigrams] if self.bigrams else []

    def is_stopword(self, lower: Column, kind: Column) -> Column:
        """Whether a pack that claims the token's class lists it; accents count. Few words are listed, so the class comes second."""
        listed = [lower.isin(*p.stopwords) & p.claims(kind) for p in self.packs if p.stopwords]
        return reduce(or_, listed) if listed else F.lit(False)


def tokens(text: Column, config: AnalyzerConfig | None = None) -> Column:
    """array<struct<pos, surface, class, lower, is_stopword, vi, latin>> of a text."""
    config = config or AnalyzerConfig()

    def token(s: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), s.alias("surface"), T.classify(s).alias("class"), F.lower(s).alias("lower"))

    def whole(t: Column) -> Column:
        stop = config.is_stopword(t["lower"], t["class"])
        return F.struct(t["pos"].alias("pos"), t["surface"].alias("surface"), t["class"].alias("class"), t["lower"].alias("lower"), stop.alias("is_stopword"), T.fold_vietnamese(t["surface"]).alias("vi"), T.fold_latin(t["surface"]).alias("latin"))

    return F.transform(F.transform(T.surfaces(text), token), whole)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """An array made of a value that is worked out once, however often the expression has it."""
    return F.flatten(F.transform(F.array(value), of))


def variants(t: Column, mode: str, config: AnalyzerConfig) -> Column:
    """array<struct<term, field, kind>> of a token (struct lower, class, vi, latin) in the order of emission; stopwords too."""
    made = F.concat(_variants(F.array(t["lower"]), "text", "lower"), *[F.when(p.claims(t["class"]), p.variants(t, mode)).otherwise(_no_variants()) for p in config.ordered() if p.makes])
    same = lambda v: lambda h: (h["field"] == v["field"]) & (h["term"] == v["term"])
    return _let(made, lambda all_: F.filter(all_, lambda v, i: (v["term"] != "") & ~F.exists(F.slice(all_, 1, i), same(v))))


def is_plain(t: Column, config: AnalyzerConfig) -> Column:
    """Whether the lower-cased token is the only term of a token: true for most, and told faster than by making them."""
    return ~reduce(or_, [p.claims(t["class"]) & p.needs(t) for p in config.packs if p.makes], F.lit(False))


def postings(tokens_: Column, mode: str, config: AnalyzerConfig) -> Column:
    """array<struct<pos, ord, term, field, kind>> of analyzed tokens, in the order of emission; stopwords' text terms dropped."""
    content = F.exists(tokens_, lambda t: ~t["is_stopword"])

    def of_token(t: Column) -> Column:
        kept = F.filter(variants(t, mode, config), lambda v: ~((v["field"] == "text") & t["is_stopword"] & content))
        return F.transform(kept, lambda v, k: F.struct(t["pos"].alias("pos"), k.alias("ord"), v["term"].alias("term"), v["field"].alias("field"), v["kind"].alias("kind")))

    found = F.flatten(F.transform(tokens_, of_token))
    if not config.pairing():
        return found
    claimed = lambda t: reduce(or_, [p.claims(t["class"]) for p in config.pairing()])
    both = F.filter(_steps(tokens_), lambda i: claimed(F.get(tokens_, i)) & claimed(F.get(tokens_, i + 1)))
    pairs = F.transform(both, lambda i: F.struct(F.get(tokens_, i)["pos"].alias("pos"), F.lit(1_000_000).alias("ord"), F.concat(F.get(tokens_, i)["vi"], F.lit("_"), F.get(tokens_, i + 1)["vi"]).alias("term"), F.lit("phrase").alias("field"), F.lit("bigram").alias("kind")))
    return F.concat(found, pairs)


def _steps(items: Column) -> Column:
    """The places of an array but the last."""
    return F.when(F.size(items) > 1, F.sequence(F.lit(0), F.size(items) - 2)).otherwise(F.array().cast("array<int>"))


# The same analysis by words: a token's terms depend on its surface alone, so that equal words of a text are worked out once. What
# depends on a word's place, phrases and whether a text has more than stopwords, is read off the words in their order.


def listed(word: Column, config: AnalyzerConfig) -> Column:
    """Whether a surface is a stopword."""
    every = [s for p in config.packs for s in p.stopwords]
    return F.lower(word).isin(*every) & config.is_stopword(F.lower(word), T.classify(word)) if every else F.lit(False)


def has_content(words: Column, config: AnalyzerConfig) -> Column:
    """Whether a text's surfaces are more than stopwords."""
    return F.exists(words, lambda w: ~listed(w, config))


def pairs(words: Column, config: AnalyzerConfig) -> Column:
    """Phrases of surfaces as "one other", with a blank, which no token has."""
    none = F.array().cast("array<string>")
    if not config.pairing():
        return none
    claimed = F.transform(words, lambda w: reduce(or_, [p.claims(T.classify(w)) for p in config.pairing()]))
    joined = lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    return _let(claimed, lambda c: F.when(F.exists(c, lambda x: x), F.transform(F.filter(_steps(c), lambda i: F.get(c, i) & F.get(c, i + 1)), joined)).otherwise(none))


def pair_term(pair: Column) -> Column:
    """The term of a phrase."""
    return F.replace(T.fold_vietnamese(pair), F.lit(" "), F.lit("_"))


def word_token(word: Column) -> Column:
    """What packs look at, of a surface."""
    return F.struct(F.lower(word).alias("lower"), T.classify(word).alias("class"), T.fold_vietnamese(word).alias("vi"), T.fold_latin(word).alias("latin"))


def makes(word: Column, name: str, config: AnalyzerConfig) -> Column:
    """Whether a surface has terms of a field besides text that is not the one of phrases."""
    kind = T.classify(word)
    return reduce(or_, [p.claims(kind) for p in config.packs if p.makes and name in (p.fields or ())], F.lit(False))


def analyze(frame: DataFrame, text: str, mode: str = "index", config: AnalyzerConfig | None = None) -> DataFrame:
    """The frame with columns `tokens` and `postings` of its text column."""
    config = config or AnalyzerConfig()
    return frame.withColumn("tokens", tokens(F.col(text), config)).withColumn("postings", postings(F.col("tokens"), mode, config))


def exploded(frame: DataFrame, array: str, *keep: str) -> DataFrame:
    """Columns of keep and one row `p` for each element. An outer explode: for a plain one Spark infers a filter on the array's
    size and moves it below the columns that make the array, where every token would be worked out once for each other."""
    return frame.select(*keep, F.explode_outer(array).alias("p")).where(F.col("p").isNotNull())


def canonical(tokens_: Column, config: AnalyzerConfig | None = None) -> Column:
    """One term for each position: the first text term that a pack makes, else the lower-cased token; stopwords dropped unless all are."""
    packs = [p for p in (config or AnalyzerConfig()).ordered() if p.makes]
    content = F.exists(tokens_, lambda t: ~t["is_stopword"])
    kept = F.filter(tokens_, lambda t: ~(t["is_stopword"] & content))
    made = lambda p, t: F.when(p.claims(t["class"]), F.get(F.filter(p.variants(t, "query"), lambda v: v["field"] == "text"), F.lit(0))["term"])
    return F.transform(kept, lambda t: F.coalesce(*[made(p, t) for p in packs], t["lower"]))
