"""Native column expressions on text: folding, tokens, vowel counts, predicates.

All of them stay inside the JVM. ``\\w`` and ``\\s`` are ASCII in Java patterns unless ``(?U)`` is
set, so classes are spelled out or prefixed.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _precomposed() -> tuple[str, str]:
    """Accented Latin letters of one code point, and the ASCII letters they are built on."""
    accented, plain = [], []
    for code in range(0xC0, 0x1EFA):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _precomposed()

#: The letter classes, strip characters and signs of the normalization rules.
LETTERS = "a-zA-ZÀ-ỹ"
WORD = f"[{LETTERS}]+"
STRIP_CHARS = ".,!?;:\"'()[]{}…“”‘’"
ACCENTED_VOWELS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
PLAIN_VOWELS = "aeiouy"
CJK = "[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\uac00-\\ud7af]+"
SCAN_TOKEN = (
    r"(?U)(?:https?://|www\.)\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[a-zA-ZÀ-ỹ\d_]+|" + CJK + r"|\r?\n[\r\n]*|[^\s\w]|[^\s]"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_diacritics(text: Column | str) -> Column:
    """Accents off, case kept, đ as d. Exact for composed (NFC) text."""
    return F.translate(col(text), _ACCENTED + "đĐ", _PLAIN + "dD")


def fold(text: Column | str) -> Column:
    """Lower case without accents."""
    return strip_diacritics(F.lower(col(text)))


def scan_tokens(text: Column | str) -> Column:
    """The scan tokenizer: URLs, words, CJK runs, line breaks, signs; only white space is dropped."""
    return F.regexp_extract_all(col(text), F.lit(SCAN_TOKEN), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"[{LETTERS}]+"), F.lit(0))


def space_tokens(text: Column | str) -> Column:
    """Runs without white space."""
    return F.filter(F.split(col(text), r"(?U)\s+"), lambda t: t != "")


def clean_token(token: Column) -> Column:
    """Lower-cased token without outer punctuation, or an empty string unless it is all letters."""
    bare = F.btrim(F.lower(token), F.lit(STRIP_CHARS))
    return F.when(bare.rlike(r"^\p{L}+$"), bare).otherwise(F.lit(""))


#: A run without white space that is a word of letters, with or without strip characters around it.
_STRIP_CLASS = "[" + re.sub(r"([\[\]\\^-])", r"\\\1", STRIP_CHARS) + "]*+"
_CLEAN_WORD = rf"(?<!\S){_STRIP_CLASS}(\p{{L}}++){_STRIP_CLASS}(?!\S)"


def clean_tokens(text: Column | str) -> Column:
    """The cleaned tokens of a text, without those that aren't words; one pass of one pattern."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("(?U)" + _CLEAN_WORD), F.lit(1))


def clean_slots(text: Column | str) -> Column:
    """A cleaned token for each token of a text, an empty string where it isn't a word."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(rf"(?U){_CLEAN_WORD}|\S++"), F.lit(1))


def is_word(token: Column) -> Column:
    """All letters of the Latin and Vietnamese range."""
    return token.rlike(f"^[{LETTERS}]+$")


def ngrams(tokens: Column | str, n: int) -> Column:
    """Arrays of n successive tokens; none where there are fewer.

    Shifted slices are zipped, so that nothing but the zipped array is read inside the lambda:
    an expression there would be worked out anew for every token.
    """
    tokens = col(tokens)
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice(tokens, F.lit(j + 1), count).alias(f"t{j}") for j in range(n)))
    return F.transform(zipped, lambda g: F.array(*(g.getField(f"t{j}") for j in range(n))))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def accented_vowels(text: Column | str) -> Column:
    return count_chars(F.lower(col(text)), ACCENTED_VOWELS)


def all_vowels(text: Column | str) -> Column:
    return count_chars(F.lower(col(text)), ACCENTED_VOWELS + PLAIN_VOWELS)


def alpha_ratio(text: Column | str) -> Column:
    """Share of letters; 0 for an empty text."""
    text = col(text)
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"\P{L}", "")) / F.length(text)).otherwise(F.lit(0.0))


def accent_ratio(text: Column | str) -> Column:
    """Accented share of all vowels; null where there is no vowel."""
    return F.when(all_vowels(text) > 0, accented_vowels(text) / all_vowels(text))


def lacks_diacritics(text: Column | str, threshold: float = 0.6, min_length: int = 8) -> Column:
    """Long enough, three letters in ten characters, and fewer accented vowels than ``threshold``."""
    bare = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    return (F.length(bare) >= min_length) & (alpha_ratio(bare) >= 0.3) & F.coalesce(accent_ratio(bare) < threshold, F.lit(False))


def short_abbreviation(token: Column) -> Column:
    """Two or three letters without a vowel."""
    return token.rlike(r"^\p{L}{2,3}$") & ~fold(token).rlike("[aeiouy]")


#: Single letters that are words.
_VOWEL_LETTERS = ACCENTED_VOWELS.replace("đ", "") + PLAIN_VOWELS


def forced_abbreviation(token: Column) -> Column:
    """Two or three characters without a vowel, or without a, e, i, o, u but with j, q, x or z."""
    low = F.lower(token)
    size = F.length(low)
    return size.between(2, 3) & (~fold(low).rlike("[aeiouy]") | (~fold(low).rlike("[aeiou]") & low.rlike("[jqxz]")))


def suspected_abbreviation(token: Column) -> Column:
    """A single letter that is no vowel, or a forced abbreviation."""
    single = (F.length(token) == 1) & ~F.lower(token).isin(list(_VOWEL_LETTERS))
    return single | forced_abbreviation(token)


def has_diacritics(token: Column | str) -> Column:
    return fold(token) != F.lower(col(token))


def true_abbreviation(abbr: Column, expanded: Column) -> Column:
    """The expansion changes more than accents (đ counts as a letter of its own)."""
    bare = lambda c: F.translate(F.lower(c), _ACCENTED, _PLAIN)
    return bare(abbr) != bare(expanded)


def phonetic_fold(text: Column | str) -> Column:
    """Folded, with ch and tr at word starts taken as one."""
    return F.regexp_replace(fold(text), r"\b(?:ch|tr)", "tr")


def hmac_sha256(value: Column, secret: str, namespace: str) -> Column:
    """The keyed hash (RFC 2104) of a namespace, a byte 0 and a value, in hexadecimal; null stays null (STR-X3)."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    message = F.concat(inner, F.lit(namespace.encode() + b"\0"), F.encode(value.cast("string"), "UTF-8"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(message, 256))), 256)


def squeeze(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def canonical(text: Column | str) -> Column:
    """Key under which meanings and contexts are compared."""
    return squeeze(F.lower(col(text)))


def cache_key(text: Column | str) -> Column:
    """SHA-256 of the squeezed, lower-cased text."""
    return F.sha2(F.lower(squeeze(text)), 256)


def phrase_key(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, F.lower), "_")


def collapse_repeats(token: Column, least: int) -> Column:
    """Runs of one letter, ``least`` long or longer, as that letter."""
    return F.regexp_replace(token, rf"([{LETTERS}])\1{{{least - 1},}}", "$1")


def question_opening(line: Column) -> Column:
    """A line that opens like a question and holds no signs, digits or literals."""
    opens = line.rlike(r"(?iU)^(?:tại sao|vì sao|bao giờ|bao nhiêu)\s+\S")
    literal = line.rlike(r"(?U)(?<!\w)[A-Z][A-Z0-9]+(?!\w)") | line.rlike(r"(?U)\b\p{Lu}\p{Ll}*[ \t]+\p{Lu}\p{Ll}*\b") | line.rlike(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]+[A-Z])[A-Za-z0-9]+")
    return opens & ~line.rlike(r"[\p{P}\p{S}\p{Nd}]") & ~literal


def append_question_mark(text: Column | str) -> Column:
    """A question mark after the last line, before trailing white space, where it opens like a question."""
    text = col(text)
    body = F.regexp_replace(text, r"(?U)\s+$", "")
    tail = F.substring(text, F.length(body) + 1, F.length(text))
    line = F.trim(F.substring_index(body, "\n", -1))
    return F.when(question_opening(line), F.concat(body, F.lit("?"), tail)).otherwise(text)


def punctuation(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"\p{P}"), F.lit(0))


def preserves_punctuation(source: Column, output: Column) -> Column:
    """The two texts have the same punctuation in the same order."""
    return punctuation(source) == punctuation(output)


def change_kinds(before: Column, after: Column) -> Column:
    """The labels that describe a change: deletion, case, diacritic, whitespace, else spelling (CHG1)."""
    bare = lambda c: F.translate(F.lower(c), _ACCENTED, _PLAIN)  # noqa: E731  đ stays
    compact = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    both = (before != "") & (after != "")
    same_case = F.lower(before) == F.lower(after)
    deleted = ((before != "") & (after == "")) | (both & F.contains(F.lower(before), F.lower(after)) & (F.length(before) > F.length(after)))
    accents = both & ~((before != after) & same_case) & (bare(before) == bare(after))
    labels = F.array_compact(
        F.array(
            F.when(deleted, F.lit("deletion")),
            F.when(accents, F.lit("diacritic")),
            F.when(((before != after) & same_case) | (accents & ~same_case), F.lit("case")),
            F.when((before != after) & (compact(before) == compact(after)), F.lit("whitespace")),
        )
    )
    return F.when(F.size(labels) == 0, F.array(F.lit("spelling"))).otherwise(labels)


def string_list(text: Column) -> Column:
    """A JSON list of strings, a JSON string or plain text as an array of trimmed, non-empty strings."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    parsed = F.when(bare.startswith("["), F.from_json(bare, "array<string>")).when(bare.startswith('"'), F.array(F.from_json(F.concat(F.lit('{"v":'), bare, F.lit("}")), "v string")["v"]))
    items = F.coalesce(parsed, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array(bare)))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def ordered_union(*arrays: Column) -> Column:
    """Distinct trimmed values in first-seen order, without blanks."""
    joined = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))
    return F.array_distinct(F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def confidence(value: Column, missing: float = 1.0) -> Column:
    """A number from 0 to 1; ``missing`` where it isn't a number. Zero stays zero."""
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(missing)), F.lit(0.0)), F.lit(1.0))
