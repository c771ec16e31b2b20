from collections import Counter

import pytest

from campanile.llm import line_frequency
from campanile.llm.line_frequency import drop_boilerplate


def brute(rows, ratio=0.05, least=2, few=4, few_ratio=0.5):
    """Equal texts of a host are one page."""
    distinct = {(s or "", t or "") for s, t in rows}
    pages = Counter(s for s, _ in distinct)
    seen = Counter((s, x) for s, t in distinct for x in set(t.split("\n")))

    def goes(s, x):
        n, k = pages[s], seen[s, x]
        return x.strip(" \t\n\v\f\r") and k >= least and k > ratio * n and (k >= few or k > few_ratio * n)

    return sorted(((s, t if t is None else "\n".join(x for x in t.split("\n") if not goes(s or "", x))) for s, t in rows), key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_matches_brute_force_by_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(line_frequency, "BROADCAST_LINES", limit)
    rows = [("hot", f"menu\nbody {i}\n\n menu\nfoot") for i in range(60)] + [("hot", "menu")] * 3 + [("b", "menu\nown"), ("b", None), (None, "menu"), (None, "menu"), ("", "menu\nx"), ("b", "")]
    rows += [(f"h{i % 9}", f"line {i % 4}\nrest {i}\n") for i in range(120)]
    df = spark.createDataFrame([(s, t, 5) for s, t in rows], "source string, text string, n_pages int")
    for ratio, least, few in ((0.05, 2, 4), (0.05, 4, 4), (0.5, 2, 2), (0.0, 1, 1)):
        out = drop_boilerplate(df, max_ratio=ratio, min_pages=least, few_pages=few)
        assert out.columns == ["source", "text", "n_pages", "n_dropped_lines"]
        assert sorted(((r.source, r.text) for r in out.collect()), key=str) == brute(rows, ratio, least, few)


def test_no_rows_and_a_clash(spark):
    df = spark.createDataFrame([], "source string, text string, n_dropped_lines int")
    assert drop_boilerplate(df).count() == 0 and drop_boilerplate(df).columns == df.columns


def test_planted_lines_of_hot_middle_and_tiny_hosts(spark):
    own = lambda h, i: f"{h} writes text {i} of its own\nand ends it {i}"
    rows = [(h, f"menu of {h}\n{own(h, i)}\nrare of {h} {i // 2}") for h, n in (("hot", 3000), ("middle", 60), ("tiny", 3)) for i in range(n)]
    copied = "a whole document\nthat was copied\nmany times"
    rows += [(h, copied) for h in ("hot", "middle") for _ in range(700)]
    # two near copies on a host of thirty pages, and two pages that share a line on a host of two
    rows += [("small", own("small", i)) for i in range(28)] + [("small", f"shared one\nshared two\nend {i}") for i in range(2)]
    rows += [("two", f"head\nown {i}") for i in range(2)]
    out = drop_boilerplate(spark.createDataFrame(rows, "source string, text string")).collect()
    assert sorted(((r.source, r.text) for r in out), key=str) == brute(rows)
    texts = [(r.source, r.text) for r in out]
    assert not any("menu of" in t for _, t in texts) and not any("head" in t for s, t in texts if s == "two")
    assert sum(t == copied for _, t in texts) == 1400 and sum("shared one" in t for _, t in texts) == 2
    assert all("writes text" in t for s, t in texts if s in ("tiny", "small") and "shared" not in t)
    assert sum("rare of hot" in t for _, t in texts) == 3000
