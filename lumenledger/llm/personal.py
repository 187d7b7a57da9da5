"""Personal data in texts: patterns propose spans, checks confirm them, words nearby adjust the score.

Each kind of data has a pattern, a check of what the pattern matched (digits by Luhn, mod 97,
mod 23 or mod 11-10, parts of addresses and dates by their ranges) and words that make it
likelier or less likely when they stand near. A match that fails its check is dropped. A span's
score is its kind's weight, what its check adds, and what the words nearby add or take; of the
kinds beyond the base ones, spans of ``LEAST`` or more are reported, and of those that overlap
the one of highest score, if it overlaps no base span.

The base kinds (email, ip, card, phone) are always reported where pattern and check hold,
whatever stands near or overlaps. They are matched leftmost, and those of one kind do not overlap.

Spans are places in code points, end exclusive. All patterns are of ASCII characters, so the UTF-8
bytes are searched, and each search takes time in proportion to the text, whatever is in it. Null
is the empty text. Texts of any length are searched whole; repeated rows each get their
answer; an empty table gives an empty result. Only doc_id and text are read. Nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, give_back, small_batches, texts

#: A span's score from which it is reported.
LEAST = 0.5
#: Bytes before and after a span that words nearby are looked for in.
BEFORE, AFTER = 60, 30
#: What words nearby add to a score or take from it.
LIKELIER, UNLIKELIER = 0.3, 0.3
_ADVERSE = rb"isbn|issn|doi|version|release|invoice|rechnung|facture|factura|order|bestellung|commande|pedido|sku|serial|build|commit"


def luhn(digits: bytes) -> bool:
    """Whether the last digit checks the others by Luhn's sum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: bytes) -> bool:
    """Whether an account number (country, check digits, account) leaves 1 when divided by 97; a letter counts as two digits."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def mod11_10(digits: bytes) -> bool:
    """Whether the last digit checks the others by the hybrid system modulo 11 and 10."""
    left = 10
    for d in digits[:-1]:
        left = ((left + d - 48) % 10 or 10) * 2 % 11
    return (11 - left) % 10 == digits[-1] - 48


def _digits(match: bytes) -> bytes:
    return bytes(c for c in match if 48 <= c <= 57)


def _card(match: bytes) -> bool:
    return 14 <= len(d := _digits(match)) <= 19 and luhn(d)


def _phone(match: bytes) -> bool:
    return 10 <= len(_digits(match)) <= 15


def _ip(match: bytes) -> bool:
    return all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in match.split(b"."))


def _iban(match: bytes) -> bool:
    return 15 <= len(code := match.replace(b" ", b"")) <= 34 and mod97(code)


def _ssn(match: bytes) -> bool:
    area, group, serial = match.split(b"-")
    return area not in (b"000", b"666") and area < b"900" and group != b"00" and serial != b"0000"


def _dni(match: bytes) -> bool:
    """Eight digits, or X, Y or Z and seven, and the letter of their remainder by 23."""
    number = match[:-1].rstrip(b"-").translate(bytes.maketrans(b"XYZ", b"012"), b"-")
    return b"TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == match[-1]  # fixed values


def _nir(match: bytes) -> bool:
    digits = _digits(match)
    return int(digits[:13]) % 97 == 97 - int(digits[13:])


def _tax_id(match: bytes) -> bool:
    digits = _digits(match)
    return digits[0] != 48 and mod11_10(digits)


def _birth(match: bytes) -> bool:
    first, second, third = (int(x) for x in re.split(rb"[./-]", match))
    year, month, day = (first, second, third) if first > 31 else (third, second, first)
    month, day = (day, month) if month > 12 else (month, day)
    return 1 <= month <= 12 and 1 <= day <= 31 and 1900 <= year <= 2100


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. check judges the matched bytes; near are words that make it likelier."""

    name: str
    weight: float
    pattern: bytes = b""
    check: Callable[[bytes], bool] | None = None
    confirmed: float = 0.0
    near: bytes = b""
    base: bool = False


#: In the order in which spans of one start are reported.
KINDS = (
    Kind("email", 0.9, near=rb"e-?mail|contact|kontakt|contacto|correo|courriel|reply|mailto", base=True),
    Kind("ip", 0.5, check=_ip, confirmed=0.2, near=rb"ip|host|server|client|adresse?|login|address", base=True),
    Kind("card", 0.2, rb"[0-9](?:[\x20-]?+[0-9])++", _card, 0.5, rb"card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta|cvv|cvc", base=True),
    Kind("phone", 0.6, rb"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.1, rb"phone|tel|telefon|mobile|mobil|handy|cell|call|fax|t[\xc3\xa9e]+l[\xc3\xa9e]+phone|tel[\xc3\xa9e]+fono|whatsapp", base=True),
    Kind("iban", 0.2, rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _iban, 0.6, rb"iban|account|konto|compte|cuenta|bank|bic|swift"),
    Kind("ssn", 0.1, rb"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn, 0.25, rb"ssn|social|security"),
    Kind("dni", 0.1, rb"(?<![\w.-])(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z](?![\w-])", _dni, 0.3, rb"dni|nie|nif|documento|identidad"),
    Kind("nir", 0.2, rb"(?<![\w.-])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2])\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![\w-])", _nir, 0.5, rb"nir|insee|s[\xc3\xa9e]+curit[\xc3\xa9e]+|sociale"),
    Kind("tax_id", 0.1, rb"(?<![\w.-])[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![\w-])", _tax_id, 0.25, rb"steuer|steuernummer|steuer-id|identifikationsnummer|tin|idnr"),
    Kind("phone_local", 0.3, rb"(?<![\w.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])", None, 0.0, rb"phone|tel|telefon|mobile|mobil|handy|cell|call|fax|t[\xc3\xa9e]+l[\xc3\xa9e]+phone|tel[\xc3\xa9e]+fono|whatsapp"),
    Kind("birth", 0.1, rb"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![\w/-])", _birth, 0.15, rb"born|birth|birthday|dob|geboren|geburtsdatum|geb|n[\xc3\xa9e]+e?|naissance|nacid[oa]|nacimiento"),
    Kind("mac", 0.6, rb"(?<![\w:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:-])", None, 0.0, rb"mac|device|wifi|wlan|ethernet"),
    Kind("ip6", 0.6, rb"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", None, 0.0, rb"ip|ipv6|host|server|client|address"),
    Kind("email_spelled", 0.6, near=rb"e-?mail|contact|kontakt|contacto|correo|courriel|reply"),
)
_ORDER = {k.name: i for i, k in enumerate(KINDS)}
_PATTERNS = {k.name: re.compile(k.pattern) for k in KINDS if k.pattern}
_word = lambda words: re.compile(rb"(?<![A-Za-z])(?:" + words + rb")(?![A-Za-z])", re.I)
_NEAR = {k.name: _word(k.near) for k in KINDS}
_AGAINST = _word(_ADVERSE)
_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT, _DOMAIN = re.compile(b"@"), re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT_SPELLED, _DOMAIN_SPELLED = re.compile(rb"\x20?[\[(]at[\])]\x20?", re.I), re.compile(rb"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(][Dd][Oo][Tt][\])]\x20?)[A-Za-z0-9-]+)+")
#: A chain of numbers and points from its first digit. Every four numbers of it are a match.
_CHAIN = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
#: What a text without any of this has no span without.
_ANY = re.compile(rb"[0-9@]|[\[(][Aa][Tt][\])]")


def _around(text: bytes, at: re.Pattern[bytes], domain: re.Pattern[bytes]) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+, at, domain. Each stretch between two signs is read once, so long ones cost no more."""
    bound = 0
    for sign in at.finditer(text):
        found = domain.match(text, sign.end())
        start = bound + len(text[bound : sign.start()].rstrip(_LOCAL))
        bound = max(bound, sign.end())
        if found and start < sign.start():
            bound = found.end()
            yield start, bound


def _addresses(text: bytes) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(b".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def _accounts(text: bytes) -> Iterator[tuple[int, int]]:
    """Account numbers; where groups that follow one look like more of it, what is left after dropping them is proposed."""
    for m in _PATTERNS["iban"].finditer(text):
        end = m.end()
        while not _iban(text[m.start() : end]) and (cut := text.rfind(b" ", m.start(), end)) > 0:
            end = cut
        yield m.start(), end


def _proposed(text: bytes, kind: Kind) -> Iterator[tuple[int, int]]:
    if kind.name == "email":
        return _around(text, _AT, _DOMAIN)
    if kind.name == "email_spelled":
        return _around(text, _AT_SPELLED, _DOMAIN_SPELLED)
    if kind.name == "iban":
        return _accounts(text)
    return _addresses(text) if kind.name == "ip" else (m.span() for m in _PATTERNS[kind.name].finditer(text))


def _scored(text: bytes, kind: Kind, start: int, end: int) -> float:
    score = kind.weight + kind.confirmed
    around = text[max(0, start - BEFORE) : start] + b"\n" + text[end : end + AFTER]
    score += LIKELIER if _NEAR[kind.name].search(around) else 0.0
    score -= UNLIKELIER if _AGAINST.search(around) else 0.0
    return round(min(1.0, max(0.0, score)), 6)


def _apart(ranked: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Of the ranked spans, those that overlap none of the taken and no higher one."""
    taken, kept = sorted(taken), []
    merged: list[tuple[int, int]] = []
    for s, e in taken:
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    for span in ranked:
        s, e = span[1], span[2]
        i = bisect_left(merged, (e,))
        if not i or merged[i - 1][1] <= s:
            merged.insert(i, (s, e))
            kept.append(span)
    return kept


def find(text: bytes) -> list[tuple[str, int, int, float, bool]]:
    """kind, start and end in code points, score, whether a base span; by start, then in the order of KINDS."""
    if not _ANY.search(text):
        return []
    base, more = [], []
    for kind in KINDS:
        for start, end in _proposed(text, kind):
            if kind.check is None or kind.check(text[start:end]):
                (base if kind.base else more).append((kind.name, start, end, _scored(text, kind, start, end), kind.base))
    ranked = sorted((x for x in more if x[3] >= LEAST), key=lambda x: (-x[3], x[1] - x[2], x[1], _ORDER[x[0]]))
    found = sorted(base + _apart(ranked, [x[1:3] for x in base]), key=lambda x: (x[1], _ORDER[x[0]]))
    return found if text.isascii() else _in_code_points(text, found)


def _in_code_points(text: bytes, found: list[tuple]) -> list[tuple]:
    data, places, last, n = np.frombuffer(text, np.uint8), {}, 0, 0
    for at in sorted({p for x in found for p in x[1:3]}):
        n += int(np.count_nonzero((data[last:at] & 0xC0) != 0x80))
        places[at], last = n, at
    return [(k, places[s], places[e], *rest) for k, s, e, *rest in found]


FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row: kind, start, end, score, base."""
    names = ("kind", "start", "end", "score", "base")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            rows = [[dict(zip(names, x, strict=True)) for x in find(t)] for t in texts(block["text"])]
            yield pa.RecordBatch.from_arrays([block["doc_id"].cast(pa.int64()), pa.array(rows, _SPANS)], ["doc_id", "spans"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tell, FOUND)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row, with a mark such as <email> for each stretch of overlapping spans, named after the first. Null stays null."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20):
            out = []
            for text in block["text"].to_pylist():
                parts, at = [], 0
                for kind, start, end, *_ in find(text.encode()) if text else ():
                    if start >= at:
                        parts += [text[at:start], f"<{kind}>"]
                    at = max(at, end)
                out.append(text if not parts else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([block["doc_id"].cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tell, "doc_id long, text string")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: how many base spans of each kind there are, the digest of these, and all spans."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    many = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(many(k.name).alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
