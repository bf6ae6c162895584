import re
from collections import Counter

from tessera.llm import quality_rules
from tests.llm import odd


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_odd_rows(spark):
    rows = odd.rows() + [
        (20 + k, t, "en", *odd.rows()[0][3:]) for k, t in enumerate([
            "a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x " * 40, "one\ntwo\none\n\n \n \n#$%&|<>*\none ",
            "a b c d e f g h a b c d e f g h b c d e f g h a",
        ])
    ]
    found = quality_rules.judge(spark.createDataFrame(rows, odd.SCHEMA)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert odd.ordered(got) == odd.ordered((i, *brute(t)) for i, t, *_ in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(odd.empty(spark)).collect() == []


def test_filter_on_the_verdict(spark):
    """The verdict can be a filter: long texts stay linear when the optimizer moves expressions."""
    text = " ".join(f"w{i % 5000}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.judge(df).where("not kept").count() == 1


def test_plan_has_no_python(spark):
    plan = quality_rules.judge(odd.table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash", plan)
