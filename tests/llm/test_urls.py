from __future__ import annotations

from duotext.llm.urls import judge_urls

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SLUGS = [a + b for a in LETTERS[:10] for b in LETTERS[:20]]


def verdicts(spark, rows):
    df = spark.createDataFrame([(i, f"http://h.org/{path}", bad) for i, (path, bad) in enumerate(rows)], "page_id long, url string, bad boolean")
    got = {r.page_id: r.verdict for r in judge_urls(df).collect()}
    return [(got[i] == "block") == bad for i, (_, bad) in enumerate(rows)]


def test_segments_are_generalised_at_any_depth(spark):
    assert all(verdicts(spark, [(f"a/b/{s}/{end}", end == "bad") for s in SLUGS for end in ("bad", "good")]))
    assert all(verdicts(spark, [(f"a/b/c/{s}/d/e/{end}", end == "bad") for s in SLUGS for end in ("bad", "good")]))


def test_a_small_bad_branch_of_a_wide_parent_is_kept(spark):
    rows = [(f"{d}/{i}", False) for d in SLUGS[:99] for i in range(20)] + [(f"spam/{i}", True) for i in range(20)]
    assert all(verdicts(spark, rows))


def test_single_labels_do_not_keep_a_branch(spark):
    assert all(verdicts(spark, [(f"{s}/{'good' if i % 10 else 'bad'}", i % 10 == 0) for i, s in enumerate(SLUGS)]))


def test_a_chain_of_neighbours_is_no_group_if_its_ends_differ(spark):
    rows = [(f"{s}/page", False) for s in SLUGS for _ in range(10)]
    for share in (30, 45, 60, 75, 90):
        rows += [(f"dir-{chr(97 + share // 15)}/x{LETTERS[i]}", 100 * i < 20 * share) for i in range(20)]
    df = spark.createDataFrame([(i, f"http://h.org/{path}", bad) for i, (path, bad) in enumerate(rows)], "page_id long, url string, bad boolean")
    blocked = {rows[r.page_id][0].split("/")[0] for r in judge_urls(df).where("verdict = 'block'").collect()}
    assert blocked == {"dir-f", "dir-g"}
    # Neighbours that are alike from end to end are still one group.
    rows = [(f"{s}/page", False) for s in SLUGS for _ in range(10)] + [(f"bad-{c}/x{LETTERS[i]}", i < 15) for c in "abc" for i in range(16)]
    df = spark.createDataFrame([(i, f"http://h.org/{path}", bad) for i, (path, bad) in enumerate(rows)], "page_id long, url string, bad boolean")
    assert {r.template.split("/")[1] for r in judge_urls(df).where("verdict = 'block'").collect()} == {"{+1}"}
