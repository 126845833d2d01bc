import re
from collections import Counter

from remembra.llm.repetition import repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def covered(n):
        c = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        return {k + j for k in range(len(w) - n + 1) if c[tuple(w[k : k + n])] > 1 for j in range(n)}

    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered(3)), sum(len(w[k]) for k in covered(5)), sum(len(w[k]) for k in covered(10)))


def test_against_brute_force(spark):
    clean = " ".join(f"word{i}é" for i in range(300))
    texts = [None, "", " \t\n", "one", clean, clean + "\n" + clean, "a b c\n" * 40, "x " * 200, "# $ <b>\n\n\x0bé\x1fß ok\n# $ <b>", clean + "\nsame line here\nsame line here", "tail " * 5 + clean * 3]
    rows = [(i, t, "extra", 1) for i, t in enumerate(texts)] + [(4, clean, "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = repetition_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_chars_5, r.dup_chars_10) == brute(texts[r.doc_id]), r
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {4}  # one of the three lines of 9 repeats another


def test_empty_table(spark):
    assert repetition_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
