"""Added PII spans: what is planted in real texts is found, clean texts stay as they are, and many spans cost little."""

import random
import time

from lexigrove.llm import pii
from tests.conftest import DATA

PLANTED = {
    "email": ("jane.doe [at] mailbox [dot] org", "k.lee(at)example.com", "bob_7 at webhost dot net", "ana[AT]correo[DOT]es", "max <at> firma.de"),
    "ip": ("fe80::1ff:fe23:4567:890a", "10[.]0[.]3[.]17", "2001:db8:85a3:8d3:1319:8a2e:370:7348", "192(.)168(.)4(.)20"),
    "card": ("5500.0000.0000.0004", "4111.1111.1111.1111"),
    "phone": ("(212) 555-0187", "0049 301 234 5678", "415-555-0132", "+1/202/555-0191"),
}
CLEAN = ("2024-03-09", "version 10.2.33", "09:41:07", "1.250.000", "ISBN 9780306406", "page 12 at the top.", "see table 3-4-5", "ratio 16:9:4", "look at this. dot the i")


def texts(spark):
    """Texts with places between words."""
    return [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r["text"] and places(r["text"])]


def places(text):
    return [k for k, c in enumerate(text) if c == " " and text[k - 1 : k].isalpha()]


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"]} - {(s["kind"], s["start"], s["end"]) for s in r["base"]} for r in pii.find_pii(df, pii.train()).collect()}


def planted(rng, real, choose):
    rows, at_of = [], {}
    for i in range(400):
        text = rng.choice(real)
        kind, span = choose()
        at = rng.choice(places(text))
        rows.append((i, f"{text[:at]} {span}{text[at:]}"))
        at_of[i] = (kind, at + 1, at + 1 + len(span))
    return rows, at_of


def test_recall_and_precision(spark):
    rng, real = random.Random(6), texts(spark)

    def right():
        kind = rng.choice(list(PLANTED))
        return kind, rng.choice(PLANTED[kind])

    rows, want = planted(rng, real, right)
    got = found(spark, rows)
    caught = {k: [any(s[0] == k and s[1] < want[i][2] and want[i][1] < s[2] for s in got[i]) for i in want if want[i][0] == k] for k in PLANTED}
    assert sum(map(sum, caught.values())) >= 0.9 * len(want), {k: sum(v) / len(v) for k, v in caught.items()}
    rows, want = planted(rng, real, lambda: (None, rng.choice(CLEAN)))
    got = found(spark, rows)
    wrong = [rows[i][1][s[1] : s[2]] for i in want for s in got[i] if s[1] < want[i][2] and want[i][1] < s[2]]
    assert len(wrong) <= 0.1 * len(rows), wrong[:20]
    # texts as they are: hardly a span is added
    plain = found(spark, list(enumerate(real)))
    added = [real[i][s[1] : s[2]] for i, spans in plain.items() for s in spans]
    assert len(added) <= 0.1 * len(real), added[:20]


def test_many_spans_in_one_text(spark):
    text = "call (212) 555-0187 or jane.doe [at] mailbox [dot] org, a@b.co " * 33_000
    began = time.time()
    spans = found(spark, [(1, text)])[1]
    assert len(spans) >= 60_000 and time.time() - began < 60
