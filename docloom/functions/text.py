"""Text functions as Column expressions. Python is used for Unicode normal forms alone, which Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as K

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(values: str | list[str]) -> Column:
    return F.array(*(F.lit(w) for w in (values.split() if isinstance(values, str) else values)))


#: Values of a batch that are Python's at a time; all others stay in Arrow.
AT_ONCE = 256


def each(values: pa.Array, f: Callable) -> pa.Array:
    """f of each value, as strings: a batch takes little more than its own size again."""
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([f(x) for x in values.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(values), AT_ONCE))])


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    return each(s, lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return each(s, lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def _replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


#: Characters that only some steps of the normaliser, or NFC, can change: soft hyphens, controls and spaces beyond ASCII, and all from U+0300 on.
_BEYOND = r"[\x{0080}-\x{00A0}\x{00AD}\x{0300}-\x{10FFFF}]"
_CONTROLS = r"[\x00-\x08\x0B-\x1F\x7F]"
#: Arabic marks and the letter stretcher, which go from every text.
_MARKS = r"\x{0640}\x{0610}-\x{061A}\x{064B}-\x{0652}\x{0655}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"


def normalize(c: ColumnOrName) -> Column:
    """The normaliser of Persian text, in its fixed order of thirteen steps; idempotent.

    Texts of ASCII and precomposed Latin letters take only the steps that can change them, and no way through Python; most of
    them hold nothing that a step changes, which a search for what the steps look for tells."""
    x = _col(c)
    own = reduce(Column.__or__, (F.contains(x, F.lit(w)) for w in ["!!", "??", ",,", ";;", "::", "....", "  ", "\t", " \n", "\n "]), x.rlike(_CONTROLS))
    short = _replace_all(x, [(r"([!?,;:])\1+", "$1"), (r"\.{4,}", "..."), (r"\r\n?", "\n"), (_CONTROLS + "+", ""), (r"[ \t]{2,}|\t", " "), (r" ?\n ?", "\n")])
    short = F.trim(F.when(own, short).otherwise(x))
    composed = nfc(F.when(x.rlike(_BEYOND), x))  # null for other texts
    x = F.regexp_replace(composed, r"[\p{Cf}&&[^\x{200C}]]", "")
    x = F.regexp_replace(x, f"[{_MARKS}]", "")
    x = F.translate(x, "يىك" + K.PERSIAN_DIGITS + K.ARABIC_DIGITS, "ییک" + K.LATIN_DIGITS * 2)
    x = F.translate(x, "“”„‟″‘’‚‛′？，；", "\"\"\"\"\"'''''؟،؛")
    x = F.replace(x, F.lit("…"), F.lit("..."))
    full = _replace_all(x, [
        (r"([؟!?,،؛;:])\1+", "$1"), (r"\.{4,}", "..."),
        (r"\x{200C}+", K.ZWNJ), (r"(?<!\p{L})\x{200C}|\x{200C}(?!\p{L})", ""),
        (r"\r\n|\r", "\n"), (r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", " "),
        (r"[\p{Cc}&&[^\n\t]]", ""), (r"[ \t]+", " "), (r"(?md)^[ \x{2028}\x{2029}]+|[ \x{2028}\x{2029}]+$", ""),
    ])
    return F.when(composed.isNull(), short).otherwise(full)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def casefold(c: ColumnOrName) -> Column:
    """Lower case with ß as ss, as caseless matching wants it."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def find_all(c: ColumnOrName, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def strip(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank(c: ColumnOrName) -> Column:
    """Whether `strip` leaves nothing; true of null."""
    return F.coalesce(~_col(c).rlike(r"[^\s\p{Z}]"), F.lit(True))


def normally_blank(c: ColumnOrName) -> Column:
    """`blank` of `normalize`, told from the text itself: no step makes a visible character out of white space and what goes, or the reverse."""
    return F.coalesce(~_col(c).rlike(rf"[^\p{{Z}}\p{{Cc}}\p{{Cf}}{_MARKS}]"), F.lit(True))


def strip_markdown(c: ColumnOrName) -> Column:
    """Fences, images, links, inline code, emphasis, headings, in that order."""
    return strip(_replace_all(_col(c), [
        (r"(?s)```.*?```", ""), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"`([^`]+)`", "$1"), (r"(\*\*|__|\*|_)(.*?)\1", "$2"), (r"(?md)^#{1,6}\s+", "")]))


def language(c: ColumnOrName, share: float = 0.6, first: int | None = None) -> Column:
    """Fa, en or unknown by the share of Arabic or Latin letters of the whole text, or of its `first` characters.

    The thresholds are our own: under 20 characters, or without a share of `share`, unknown."""
    def counts(arabic: Column, latin: Column, every: Column) -> Column:
        return F.struct(arabic.alias("arabic"), latin.alias("latin"), F.greatest(every, F.lit(1)).alias("every"))

    def of(s: Column) -> Column:
        # counted by runs, as lengths: Latin letters are what the rest lacks, all others are looked for in the rest alone; of ASCII letters all are Latin, and one tells their share
        mixed = let(F.regexp_replace(s, "[A-Za-z]+", ""), lambda rest: counts(
            F.length(F.regexp_replace(rest, r"[^\x{0600}-\x{06FF}]+", "")), F.length(s) - F.length(rest), F.length(s) - F.length(rest) + F.length(F.regexp_replace(rest, r"\P{L}+", ""))))
        n = F.when(F.octet_length(s) == F.length(s), counts(F.lit(0), s.rlike("[A-Za-z]").cast("int"), F.lit(1))).otherwise(mixed)
        return let(n, lambda n: F.when(F.length(s) < 20, "unknown").when(n["arabic"] / n["every"] >= share, "fa").when(n["latin"] / n["every"] >= share, "en").otherwise("unknown"))

    s = F.trim(_col(c))
    return let(F.substring(s, 1, first) if first is not None else s, of)


def to_latin_digits(c: ColumnOrName) -> Column:
    return F.translate(_col(c), K.PERSIAN_DIGITS + K.ARABIC_DIGITS, K.LATIN_DIGITS * 2)


def to_persian_digits(c: ColumnOrName) -> Column:
    return F.translate(to_latin_digits(c), K.LATIN_DIGITS, K.PERSIAN_DIGITS)


def to_arabic_digits(c: ColumnOrName) -> Column:
    return F.translate(to_latin_digits(c), K.LATIN_DIGITS, K.ARABIC_DIGITS)


def sentences(c: ColumnOrName) -> Column:
    """Sentences, split behind an end mark and white space, or at blank lines."""
    return F.filter(F.transform(F.split(_col(c), r"(?<=[.!?؟。\n])\s+|\n{2,}"), strip), lambda x: x != "")


def number_runs(c: ColumnOrName) -> Column:
    """Runs of digits of any script, with separators."""
    return find_all(c, r"(?:[۰-۹٠-٩0-9][٬,]?)+")


def short_numbers(c: ColumnOrName) -> Column:
    """T14, bounded: whole numbers of up to four digits, without leading zeros, as a set."""
    found = find_all(c, r"(?<![\p{L}\p{N}_\x{0600}-\x{06FF}])([0-9]{1,4}|[۰-۹]{1,4})(?![\p{L}\p{N}_\x{0600}-\x{06FF}])", 1)
    return F.array_distinct(F.transform(found, lambda x: F.translate(x, K.PERSIAN_DIGITS, K.LATIN_DIGITS).cast("int").cast("string")))


def keywords(c: ColumnOrName, limit: int = 8) -> Column:
    """Persian words without stop-words, in their first order."""
    found = F.array_distinct(find_all(c, r"[\x{0600}-\x{06FF}\x{200C}]{2,}"))
    return F.slice(F.array_except(found, words(K.KEYWORD_STOPWORDS)), 1, limit)


def arabic_letters(c: ColumnOrName) -> Column:
    return F.translate(_col(c), "یک", "يك")


def without_half_spaces(c: ColumnOrName) -> Column:
    return F.replace(_col(c), F.lit(K.ZWNJ), F.lit(""))


def with_half_spaces(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), r"\s+(های|ها|ای|ام|ات)(?![\p{L}\p{N}_])", K.ZWNJ + "$1")


def collapse_spaces(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def without_punctuation(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_col(c), "[،؛؟«».]", ""))


def noisy_punctuation(c: ColumnOrName) -> Column:
    return F.concat(F.regexp_replace(_col(c), "[؟.?!]+$", ""), F.lit("؟؟!!"))


def surface_issues(c: ColumnOrName) -> Column:
    """What keeps a text from the normal form."""
    x = _col(c)
    has = lambda chars: x.rlike(f"[{chars}]")
    return F.array_compact(F.array(
        F.when(x != nfc(x), "not_nfc"), F.when(x != nfkc(x), "needs_nfkc"), F.when(has("يك"), "arabic_yeh_or_kaf"),
        F.when(x.contains("  ") | x.contains("\t"), "whitespace"), F.when(has(K.ARABIC_DIGITS), "arabic_indic_digits"),
        F.when(has(K.PERSIAN_DIGITS) & has("0-9"), "mixed_digits"), F.when(x != normalize(x), "differs_from_production_normalize")))


def token_estimate(c: ColumnOrName) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(_col(c), F.lit(r"\S+")))


def looks_like_list(c: ColumnOrName) -> Column:
    return _col(c).rlike(r"(^|\n)\s*([0-9۰-۹]+[.\)-]|[-•▪])\s+")


def looks_like_table(c: ColumnOrName) -> Column:
    return (F.regexp_count(_col(c), F.lit(r"\|")) >= 3) | (F.regexp_count(_col(c), F.lit("\t")) >= 3)


def lexical_tokens(c: ColumnOrName, normal: bool = False) -> Column:
    """Tokens for lexical search; half-spaces join, question marks fall off. `normal`: c is normalised already.

    Where no token can begin or end in a question mark, and lower case keeps the letters, the text is folded as a whole."""
    x = _col(c) if normal else normalize(c)
    found = F.transform(find_all(x, K.LEXICAL_TOKEN), lambda t: F.regexp_replace(casefold(without_half_spaces(t)), r"^[؟?]+|[؟?]+$", ""))
    return F.when(x.rlike("[؟\u0130]"), F.filter(found, lambda t: t != "")).otherwise(find_all(casefold(without_half_spaces(x)), K.TOKEN))


def all_tokens(c: ColumnOrName) -> Column:
    return F.transform(find_all(c, K.TOKEN), casefold)


def content_tokens(c: ColumnOrName, stopwords: list[str] = K.RANKING_STOPWORDS) -> Column:
    """The set of tokens with content."""
    return content_of(all_tokens(c), stopwords)


def content_of(tokens: Column, stopwords: list[str] = K.RANKING_STOPWORDS) -> Column:
    return F.array_except(F.filter(tokens, lambda t: F.length(t) > 1), words(stopwords))


def text_lines(c: ColumnOrName) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(_col(c), r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")


def ends_in_question(c: Column) -> Column:
    return c.endswith("؟") | c.endswith("?")


def question_lines(c: ColumnOrName) -> Column:
    """Lines that end in a question mark, and questions of 8 characters or more within other lines."""
    def of(line: Column) -> Column:
        inner = F.filter(F.transform(F.filter(F.split(line, r"(?<=[؟?])"), ends_in_question), strip), lambda s: F.length(s) >= 8)
        return F.when(ends_in_question(line), F.array(line)).otherwise(inner)

    # the first of each: sorted by folded text and place, then by place again
    keyed = F.array_sort(F.transform(F.flatten(F.transform(text_lines(c), of)), lambda x, i: F.struct(casefold(x).alias("key"), i.alias("i"), x.alias("x"))))
    first = let(keyed, lambda own: F.filter(own, lambda e, n: (n == 0) | (e["key"] != F.get(own, n - 1)["key"])))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def bigrams(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def phrases(c: ColumnOrName) -> Column:
    """First three, last three and pairs of tokens, the longest first (in their order if equally long)."""
    t = all_tokens(c)
    ends = F.when(F.size(t) >= 3, F.array(F.array_join(F.slice(t, 1, 3), " "), F.array_join(F.slice(t, -3, 3), " "))).otherwise(F.array().cast("array<string>"))
    found = F.concat(ends, bigrams(t))
    return F.transform(F.array_sort(F.transform(found, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda s: s["p"])


def fusion_phrases(c: ColumnOrName) -> Column:
    """T21 for lexical boosts: the whole query as well; distinct, of three characters or more."""
    whole = casefold(collapse_spaces(c))
    found = F.array_distinct(F.concat(F.array(whole), phrases(c)))
    kept = F.filter(found, lambda p: F.length(p) >= 3)
    return F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))), lambda s: s["p"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def entities(c: ColumnOrName, stopwords: list[str] = K.EVIDENCE_STOPWORDS) -> Column:
    """Tokens that look like names: with http or a dot, Latin of three, Persian of four characters or more."""
    return entities_of(all_tokens(c), stopwords)


def entities_of(tokens: Column, stopwords: list[str] = K.EVIDENCE_STOPWORDS) -> Column:
    like = lambda t: t.contains(".") | t.contains("http") | t.rlike(r"^[a-z0-9][a-z0-9._-]{2,}$") | (t.rlike(r"[\x{0600}-\x{06FF}]") & (F.length(t) >= 4))
    return F.array_except(F.filter(tokens, like), words(stopwords))


def persian_keywords(c: ColumnOrName, stopwords: list[str] = K.EVIDENCE_STOPWORDS) -> Column:
    return persian_of(content_tokens(c, stopwords))


def persian_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"[\x{0600}-\x{06FF}]"))


def marker_key(c: ColumnOrName, words_only: bool = False) -> Column:
    """The form in which gold markers are compared."""
    x = casefold(nfkc(_col(c)))
    return F.regexp_replace(x, r"[^\p{L}\p{N}_]+" if words_only else r"[\s\x{200C}]+", "")


def _letters_and_digits(x: Column) -> Column:
    x = F.translate(x, "يىك۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "ییک01234567890123456789")
    return casefold(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))


def answer_key(c: ColumnOrName) -> Column:
    """T24 for facts and echoes: letters and digits alone, in one form."""
    return _letters_and_digits(nfkc(_col(c)))


def answer_keys(c: ColumnOrName) -> Column:
    """`answer_key` of each text of an array."""
    joined = nfkc(F.array_join(F.transform(_col(c), lambda x: F.replace(x, F.lit("\x1f"), F.lit(" "))), "\x1f"))
    return F.when(F.size(_col(c)) > 0, F.transform(F.split(joined, "\x1f"), _letters_and_digits)).otherwise(F.array().cast("array<string>"))


def repair_glyphs(c: ColumnOrName, artifacts: dict[str, str] | None = None) -> Column:
    """Replace glyph artifacts standing between no letters, and set the spaces around right-to-left marks."""
    x = _col(c)
    for wrong, right in (artifacts or {}).items():
        x = F.regexp_replace(x, rf"(?<!\p{{L}}){wrong}(?!\p{{L}})", right)
    return _replace_all(x, [(r"[ \t]+([،؛؟:.!])", "$1"), (r"([،؛])(?=[^\s\d])", "$1 ")])


def reflow(c: ColumnOrName) -> Column:
    """Join wrapped lines; a line stays where the one before ends a sentence or question, or it starts an item."""
    lines = F.transform(F.split(_col(c), "\n"), lambda x: F.trim(x))  # F.trim itself takes two arguments and would get the line's number too
    step = lambda acc, x: F.when(acc == "", x).when(x == "", acc).when(acc.rlike(r"[.!?؟۔:]\z") | x.rlike(r"^([-•▪●○*]|[0-9۰-۹]{1,3}[.)])\s"), F.concat(acc, F.lit("\n"), x)).otherwise(F.concat(acc, F.lit(" "), x))
    return F.aggregate(lines, F.lit(""), step)


def quality(c: ColumnOrName, reference: ColumnOrName | None = None, artifacts: list[str] | None = None) -> dict[str, Column]:
    """Counters of what extraction left behind. With a reference text, `number_mismatches`: places at which the two
    sequences of numbers differ; with patterns of glyph artifacts, `artifacts`: how often they stand between no letters."""
    x = _col(c)
    lines = F.split(x, "\n")
    n = lambda p: F.regexp_count(x, F.lit(p))
    out = {
        "lines": F.size(lines), "blank_lines": F.size(F.filter(lines, lambda s: F.trim(s) == "")), "question_lines": F.size(F.filter(lines, lambda s: ends_in_question(F.trim(s)))),
        "numbers": F.size(number_runs(x)), "replacement_chars": n(r"\x{FFFD}"), "presentation_forms": n(r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"),
        "letter_variants": n("[يىك]"), "spacing_anomalies": n(r" {2,}| [،؛؟.,]"),
    }
    if reference is not None:
        mine, other = (F.transform(number_runs(t), to_latin_digits) for t in (x, _col(reference)))
        out["number_mismatches"] = F.size(F.filter(F.zip_with(mine, other, lambda a, b: ~a.eqNullSafe(b)), lambda d: d))
    if artifacts:
        out["artifacts"] = n("|".join(rf"(?<!\p{{L}}){a}(?!\p{{L}})" for a in artifacts))
    return out
