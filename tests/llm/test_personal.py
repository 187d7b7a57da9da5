"""Personal data: base kinds against the plain patterns, checks and scores by examples, time on hostile texts."""

import hashlib
import random
import re
import time

import pytest

from lumenledger.llm import personal as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and brute_luhn(digits)
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def with_check(rng, n):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if brute_luhn(head + c))


def samples(seed, n):
    rng = random.Random(seed)
    made = [None, "", "no data here", "a@b.c@d.e.f", "x@y", "1.2.3.4.5.6.7.8.9", "1.2.3", "01.002.0003.4 256.1.1.1", "++49 (0)30 123-456-78 90.", "😀é +1 (555) 010-2030 ü a.b@c.de"]
    for _ in range(n):
        piece = lambda: rng.choice(
            [
                "".join(rng.choice("0123456789.@+-() ab") for _ in range(rng.randint(1, 25))),
                ".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(2, 9))),
                rng.choice("- ").join(re.findall(".{1,4}", with_check(rng, rng.randint(13, 20)))),
                f"+{rng.randint(1, 99)} ({rng.randint(1, 999)}) {rng.randint(100, 99999)}-{rng.randint(1, 9999)}",
                f"{rng.choice('abc%._')}{rng.choice(['', 'é', 'x.y'])}@{rng.choice(['m', 'm.org', 'a-b.c.de.', '.com'])}",
                rng.choice(["été", "😀", "\n", " phone ", ", ", "order "]),
            ]
        )
        made.append("".join(piece() + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 8))))
    return made


def test_base_spans_are_those_of_the_plain_patterns(spark, tmp_path):
    rows = list(enumerate(samples(4, 1500))) + [(None, None), (None, "q@r.st"), (5, "q@r.st"), (5, "q@r.st")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, base int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op12_pii(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        found = brute(t)
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        want.append((i, *(sum(x[2] == k for x in found) for k in PLAIN), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by = {i: t for i, t in rows if i is not None}
    for r in got:
        if r.doc_id in by and r.doc_id != 5:
            base = {(k, s, e) for s, _, k, e in brute(by[r.doc_id])}
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            assert base <= set(spans) and all(0 <= s < e <= len(by[r.doc_id]) for _, s, e in spans)
            assert spans == sorted(spans, key=lambda x: (x[1], P._ORDER[x[0]]))
            more = [x for x in spans if x not in base]
            assert not any(a[1] < b[2] and b[1] < a[2] for a in more for b in spans if a is not b)
    assert P.personal_data(df.limit(0)).count() == 0


def kinds(text):
    return {k: text.encode()[s:e].decode() for k, s, e, _, _ in P.find(text.encode())} if text.isascii() else {k: text[s:e] for k, s, e, _, _ in P.find(text.encode())}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Konto DE89 3704 0044 0532 0130 00 bitte", {"iban": "DE89 3704 0044 0532 0130 00"}),
        ("GB82WEST12345698765432", {"iban": "GB82WEST12345698765432"}),
        ("GB82 WEST 1234 5698 7654 32 AND SO ON", {"iban": "GB82 WEST 1234 5698 7654 32"}),
        ("DE88 3704 0044 0532 0130 00", {}),  # mod 97 fails
        ("my ssn is 536-22-8726.", {"ssn": "536-22-8726"}),
        ("part 536-22-8726 of the list", {}),  # nothing near makes it likely
        ("ssn 000-22-8726", {}),  # no such area
        ("DNI: 12345678Z", {"dni": "12345678Z"}),
        ("DNI: 12345678A", {}),
        ("NIE X-1234567-L", {"dni": "X-1234567-L"}),
        ("n° sécurité sociale 2 55 08 14 168 020 43", {"nir": "2 55 08 14 168 020 43"}),
        ("Steuernummer 86 095 742 719", {"tax_id": "86 095 742 719"}),
        ("Steuernummer 86 095 742 718", {}),
        ("call (555) 010-2030 now", {"phone_local": "(555) 010-2030"}),
        ("order (555) 010-2030 now", {}),
        ("née le 31/12/1984 à Lyon", {"birth": "31/12/1984"}),
        ("on 31/12/1984", {}),
        ("born 1984-13-41", {}),
        ("device 00:1A:2b:3c:4d:5e up", {"mac": "00:1A:2b:3c:4d:5e"}),
        ("host 2001:0db8:0:0:0:ff00:42:8329", {"ip6": "2001:0db8:0:0:0:ff00:42:8329"}),
        ("write to jane.doe [at] example (dot) org", {"email_spelled": "jane.doe [at] example (dot) org"}),
        ("card 4111 1111 1111 1111", {"card": "4111 1111 1111 1111"}),
        ("card 4111 1111 1111 1112", {}),
    ],
)
def test_kinds_checks_and_words_nearby(text, want):
    assert kinds(text) == want


def test_scores_rise_and_fall_with_words_nearby():
    score = lambda text: P.find(text.encode())[0][3]
    assert score("order 4111111111111111") < score("4111111111111111") < score("visa 4111111111111111")
    assert score("visa " + "x " * 60 + "4111111111111111") == score("4111111111111111")  # too far
    assert score("devisa 4111111111111111") == score("4111111111111111")  # part of a word


def test_checks():
    rng = random.Random(1)
    for _ in range(2000):
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 19)))
        assert P.luhn(digits.encode()) == brute_luhn(digits)
    assert P.mod97(b"GB82WEST12345698765432") and not P.mod97(b"GB82WEST12345698765433")
    assert P.mod11_10(b"86095742719") and not P.mod11_10(b"86095742718")


def test_spans_apart_are_those_of_a_comparison_of_all():
    rng = random.Random(2)
    for _ in range(300):
        spans = lambda n: [("k", s := rng.randint(0, 60), s + rng.randint(1, 12)) for _ in range(n)]
        ranked, taken = spans(rng.randint(0, 12)), [x[1:] for x in spans(rng.randint(0, 4))]
        kept = []
        for x in ranked:
            if all(x[2] <= s or e <= x[1] for s, e in [*taken, *(y[1:] for y in kept)]):
                kept.append(x)
        assert P._apart(ranked, taken) == kept


@pytest.mark.parametrize(
    "unit", ["a", "1", "@", "a@", "1.", "+1(", "1 ", "1-", "a.b@c-", "[at]", "AA11 ", "00:", "A1", "+1 555 555 5555 ", "1.2.3.4 ", "x@y.zz ", "4111111111111111 ", "é@b.cc "]
)
def test_hostile_texts_take_linear_time(unit):
    text = (unit * (400_000 // len(unit))).encode()
    began = time.process_time()
    P.find(text)
    assert time.process_time() - began < 6


def test_redaction(spark):
    rows = [(1, "mail é a.b@c.de or +1 (555) 010-2030!"), (2, "nothing"), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in P.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mail é <email> or <phone>!", 2: "nothing", 3: None, 4: ""}
