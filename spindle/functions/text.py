"""Text functions of the analyzer as column expressions: tokens, classes, folding, stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, letters and word lists that results depend on.
# Letters, digits and marks with separators between, none at the end; possessive, so that no text makes it go back or deep.
TOKEN = r"[\p{L}\p{N}\p{M}]++(?:[_.\-\/]++[\p{L}\p{N}\p{M}]++)*+"
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]"
UNIT = r"^[0-9]+[a-zA-Z]{1,3}$"
VIETNAMESE = {"a": "áàảãạăắằẳẵặâấầẩẫậ", "e": "éèẻẽẹêếềểễệ", "i": "íìỉĩị", "o": "óòỏõọôốồổỗộơớờởỡợ", "u": "úùủũụưứừửữự", "y": "ýỳỷỹỵ", "d": "đ"}
MARKS = "̛̣̀́̂̃̆̉"
LATIN = {"n": "ñ", "u": "üû", "o": "öø", "a": "äå", "c": "ç", "i": "îï", "e": "ë"}
LATIN_PAIRS = {"ß": "ss", "œ": "oe"}
ENGLISH_STOPWORDS = ("the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "is", "are", "be")
VIETNAMESE_STOPWORDS = (
    "và", "của", "có", "là", "các", "cho", "trong", "với", "một", "này",
    "đó", "để", "từ", "theo", "những", "hay", "hoặc", "nếu", "thì", "mà",
    "đã", "sẽ", "đang", "cũng", "vẫn", "ở", "về", "được", "bị", "do",
    "vì", "tại", "bởi", "khi", "rất", "quá", "lại", "còn", "đến", "nên",
    "như", "nó", "tôi", "bạn", "họ", "chúng", "mình", "mỗi", "mọi", "thế",
)


def _table(groups: dict[str, str]) -> tuple[str, str]:
    return "".join(groups.values()), "".join(base * len(letters) for base, letters in groups.items())


#: Letters to fold and what they fold to; marks have no counterpart and go.
VI_FROM, VI_TO = _table(VIETNAMESE)
LATIN_FROM, LATIN_TO = (VI_FROM + _table(LATIN)[0], VI_TO + _table(LATIN)[1])


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def fold_vietnamese(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(is_ascii(text), lower).otherwise(F.translate(lower, VI_FROM + MARKS, VI_TO))


def fold_latin(text: Column) -> Column:
    lower = folded = F.lower(text)
    for letter, pair in LATIN_PAIRS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return F.when(is_ascii(text), lower).otherwise(F.translate(folded, LATIN_FROM + MARKS, LATIN_TO))


def surfaces(text: Column) -> Column:
    """The tokens of a text in order, inner separators kept; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def classify(surface: Column) -> Column:
    """The class of a token: any CJK, then letters with digits, digits, accented, Latin, other. Plain words, the most, are told by one look."""
    digit, ascii_, marked = surface.rlike("[0-9]"), surface.rlike("[A-Za-z]"), surface.rlike(r"[^\x00-\x7F]")
    return (
        F.when(surface.rlike("^[A-Za-z]+$"), "WORD_LATIN").when(surface.rlike(CJK), "CJK")
        .when(digit & (ascii_ | marked), F.when(surface.rlike(UNIT), "NUMERIC_UNIT").otherwise("ALNUM_CODE"))
        .when(digit, "NUMERIC_UNIT").when(marked, "WORD_DIACRITIC").when(ascii_, "WORD_LATIN").otherwise("OTHER")
    )
