"""Evidence in the pages of its source against trying every page."""

import random

from lexigrove.operators import evaluation


def test_against_every_page(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcde" for b in ("", "x", "yz", "longer")]
    pages = [(rng.choice(("in/one.md", "TWO.md", "x\\three.html")), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)] + [("hot.md", "ax b cyz d elonger " + " ".join(rng.choices(words, k=20))) for _ in range(150)]
    pages += [("one.md", None), ("one.md", "“Quoted” – text  here")]
    items = []
    for i in range(300):
        source, text = rng.choice(pages)
        text = text or "nothing"
        lo = rng.randint(0, len(text))
        evidence = text[lo : lo + rng.choice((1, 2, 3, 5, 9, 20, 40, 80))]
        items.append((i, rng.choice((source, "two.md", "none.md")), evidence.upper() if i % 3 else evidence + " b" * (i % 2)))
    items += [(900, "one.md", None), (901, "one.md", "  "), (902, "one.md", '"quoted" - TEXT here'), (903, None, "a"), *[(1000 + i, "hot.md", "ax b cyz d elonger") for i in range(100)]]
    got = dict(evaluation.evidence_present(spark.createDataFrame(items, "id long, source string, evidence string"), spark.createDataFrame(pages, "source string, content string").repartition(4)).collect())
    form = lambda t: " ".join((t or "").lower().replace("“", '"').replace("”", '"').replace("–", "-").split())
    name = lambda s: (s or "").replace("\\", "/").split("/")[-1].lower()
    want = {i: bool(form(e)) and any(name(s) == name(p) and form(e) in form(t) for p, t in pages) for i, s, e in items}
    assert got == want and 100 < sum(want.values()) < len(want)
