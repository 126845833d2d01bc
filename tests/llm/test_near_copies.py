import random
import re

from remembra.llm.near_copies import drop_near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Places of the rows (doc_id, text) that stay."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0, i)), (d is None, d or 0, i))
    return sorted(b[2] for b in best.values())


def corpus():
    r = random.Random(2)
    word = lambda: f"w{r.randrange(3000)}"
    texts = ["", " ", "one", "One", "two words"]
    for size in (60, 120, 400):
        for _ in range(8):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.004, 0.01, 0.018, 0.03, 0.06):
                texts.append(" ".join(word() if r.random() < share else w for w in base))
    base = [word() for _ in range(200)]
    texts += [" ".join([*base, f"x{k}"]) for k in range(60)]
    return [(i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus()
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [rows[i][0] for i in kept(rows)]


def test_template_in_one_bucket(spark):
    """Thousands of texts of one template, most of them at 0.7 to 0.79 of one another, some pairs above 0.8: as brute force has it."""
    r = random.Random(9)
    base = [f"w{r.randrange(3000)}" for _ in range(160)]
    rows = []
    for i in range(1500):
        text = list(base)
        for _ in range(r.choice((2, 3, 3, 4))):
            text[r.randrange(160)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = [rows[i][0] for i in kept(rows)]
    assert sorted(x.doc_id for x in got) == want and 1 < len(want) < 1500


def test_shared_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (3, None)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(1, a), (2, b), (3, None)} <= {tuple(r) for r in got}
    assert any(r.doc_id is None and r.text.startswith(c) for r in got)
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
