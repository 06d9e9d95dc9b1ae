"""Personal data: patterns propose spans, checks confirm them, words nearby move their score.

Five kinds: email, ip, card, phone, iban. The base spans of the first four are what their pattern matches from the
left without overlaps, if the match passes its check (parts of an address up to 255, 13 to 19 digits with a sound Luhn
sum, 9 to 15 digits). They stay whatever they score. The method adds spans that a base match swallows or misses:

* card: in a run of digits that fails, one unbroken group of 13 to 19 digits, or groups of 4-4-4-4 or 4-6-5, with a
  sound Luhn sum, unless it overlaps such a candidate that starts earlier (a phone number just before a card number);
* phone: in a match with too many digits, the longest beginning with 9 to 15 digits that ends with a group before the
  next address or card; and numbers of 3-3-4 digits without a country code that overlap no other span;
* iban: two letters and two digits, 15 to 34 in all, sound by mod 97, as far as it is sound at a group's end.

A score has 40 points for the pattern, 40 for a checksum (20 for an address or a count of digits), 20 more if a word
of the kind stands within 40 characters, 30 less if a word speaks against it. Added spans need `least` points, 60
unless told otherwise, so a bare 3-3-4 number needs a word such as "phone" beside it.

Results: every row of docs gives a row, repeated rows and null doc_ids too; a null or empty text has no spans; texts
are read whole, in time linear in their length, each in one task's batch; offsets count code points, the end is
exclusive. An empty table gives an empty result. Other columns of docs are left behind, so none can clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban"]
LEAST = 60
NEAR = 40
#: Words that speak for a kind, and against it.
FOR = {
    "email": r"e-?mail|contact|write", "ip": r"ip|address|host|server", "card": r"card|visa|mastercard|credit|debit|payment",
    "phone": r"phone|tel|telephone|call|mobile|fax|cell|whatsapp", "iban": r"iban|bank|account|transfer",
}
AGAINST = {"ip": r"version|release", "card": r"order|isbn|serial|invoice|tracking"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_GROUP = re.compile(r"[0-9]+")
_FOR = {k: re.compile(rf"\b(?:{v})\b", re.ASCII | re.IGNORECASE) for k, v in FOR.items()}
_AGAINST = {k: re.compile(rf"\b(?:{v})\b", re.ASCII | re.IGNORECASE) for k, v in AGAINST.items()}


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, by the sum of its own digits."""
    return sum(int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def mod97(code: str) -> bool:
    """The first four characters go to the end; letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits(s: str) -> str:
    return "".join(_GROUP.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from each @ outwards: a search from the left would be quadratic in runs without spaces."""
    low = at = 0
    while (at := text.find("@", at)) >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        at = low = found.end() if found else at + 1
        if found:
            yield start, at


def _cards(start: int, run: str) -> Iterator[tuple[int, int]]:
    """Card numbers as whole groups of a run of digits that is none itself."""
    groups, last = [(m.start(), m.end()) for m in _GROUP.finditer(run)], 0
    for n, (a, b) in enumerate(groups):
        for sizes in ((b - a,) if 13 <= b - a <= 19 else (0,), (4, 4, 4, 4), (4, 6, 5)):
            part = groups[n : n + len(sizes)]
            if [y - x for x, y in part] == list(sizes) and luhn(digits(run[a : part[-1][1]])):
                if a >= last:
                    yield start + a, start + part[-1][1]
                last = max(last, part[-1][1])
                break


def _prefix(run: str, room: int) -> int:
    """Length of the longest beginning of a phone match with 9 to 15 digits that ends with a group, in `room`; 0 if there is none."""
    n, best = 0, 0
    for m in _GROUP.finditer(run):
        n += m.end() - m.start()
        if n > 15 or m.end() > room:
            break
        best = m.end() if n >= 9 else best
    return best


def _iban(run: str) -> int:
    """Length of the longest sound beginning at the end of a group; 0 if there is none."""
    ends = [m.start() for m in re.finditer(" ", run)] + [len(run)]
    return max((e for e in ends if 15 <= len(code := run[:e].replace(" ", "")) <= 34 and mod97(code)), default=0)


def _points(text: str, kind: str, start: int, end: int, sure: int) -> int:
    near = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    points = 40 + sure
    points += 20 if any(map(_FOR[kind].search, near)) else 0
    return points - (30 if kind in _AGAINST and any(map(_AGAINST[kind].search, near)) else 0)


def spans(text: str | None, least: int = LEAST) -> list[tuple[str, int, int, int, bool]]:
    """kind, start, end, points, base: the base spans, and added ones of at least `least` points, by kind and start."""
    text = text or ""
    base, more = [("email", a, b, 0) for a, b in emails(text)], []
    if sum(map(len, _GROUP.findall(text))) >= 4:
        base += [("ip", *m.span(), 20) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
                base.append(("card", *m.span(), 40))
            elif len(d) >= 13:
                more += [("card", a, b, 40) for a, b in _cards(m.start(), m[0])]
        starts = sorted(a for k, a, _, _ in base + more if k != "email")
        for m in _PHONE.finditer(text):
            n, later = len(digits(m[0])), bisect_right(starts, m.start())
            if 9 <= n <= 15:
                base.append(("phone", *m.span(), 20))
            elif n > 15 and (cut := _prefix(m[0], starts[later] - m.start() if later < len(starts) else len(m[0]))):
                more.append(("phone", m.start(), m.start() + cut, 20))
        for m in _IBAN.finditer(text):
            if cut := _iban(m[0]):
                more.append(("iban", m.start(), m.start() + cut, 40))
        taken = sorted((a, b) for _, a, b, _ in base + more)
        ends = list(accumulate((b for _, b in taken), max))  # of the spans up to each
        for m in _NATIONAL.finditer(text):
            a, b = m.span()
            before = bisect_left(taken, (b,))
            whole = text[max(0, a - 1) : a] not in tuple("+0123456789") and text[b : b + 1] not in tuple("0123456789")
            if whole and not (before and ends[before - 1] > a):
                more.append(("phone", a, b, 0))
    out = [(k, a, b, _points(text, k, a, b, s), True) for k, a, b, s in base]
    out += [x for k, a, b, s in more if (x := (k, a, b, _points(text, k, a, b, s), False))[3] >= least]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def find(docs: DataFrame, least: int = LEAST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, spans: array of (kind, start, end, score 0 to 1, base), by kind and start. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": p / 100, "base": o} for k, a, b, p, o in spans(t.as_py(), least)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, _TYPE)], names=[*keep, "spans"])

    rows = docs.select(*dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, spans {SPANS}")


def mask(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text with each stretch of overlapping spans replaced by the kind of its first span, as <EMAIL>."""
    found = find(docs, least, keep=("doc_id", "text"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    joined = F.aggregate(order, F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind")))),
    ).otherwise(F.concat(acc, F.array(s))))
    blank = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    whole = F.aggregate("joined", blank, lambda acc, s: F.struct(
        F.concat(acc["text"], F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substr("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    return found.withColumn("joined", joined).select("doc_id", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end."""
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return find(docs, least).select("doc_id", *map(count, KINDS[:4]), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))
