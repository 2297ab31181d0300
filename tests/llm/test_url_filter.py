import random

from newsloom.llm import url_filter as uf
from newsloom.llm.common import connected_components
from tests.conftest import SF
from tests.llm.oracle import assert_same

SCHEMA = "page_id long, url string, html string, host int, rule string, node string"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_paths_and_hubs(spark):
    rng = random.Random(8)
    cases = [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)] + [(500, i) for i in range(250, 400)], []]
    cases += [[(rng.randrange(150), rng.randrange(150)) for _ in range(n)] for n in (40, 90, 150)]
    for edges in cases:
        df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "src long, dst long")
        got = connected_components(df).collect()
        want = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
        assert len(got) == len(want)
        assert {r.node: r.component for r in got} == want


def page(i, url, canonical=None, refresh=None):
    head = f"<LINK href='{canonical}' rel=canonical>" if canonical else ""
    head += f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else ""
    return (i, url, f"<html><head>{head}</head></html>", 1, "r", "n")


def test_rules_and_aliases(spark):
    rows = [
        page(1, "https://a.example.org/es/1"), page(2, "https://A.Example.ORG/en/12?q#f"), page(3, "http://x.com/fr/1"), page(4, "http://x.com/de/1"),
        page(5, "http://x.com/en/1"), page(6, "http://xcom/de/"), page(7, "http://comcom/fr/"), page(8, None), page(9, "no scheme /de/"), page(10, ""),
        page(11, "http://b.net/1", canonical="http://x.com/de/9"), page(12, "http://b.net/2", refresh="/1"), page(13, "http://c.net/1", canonical="//x.com/fr/2"),
        page(14, "http://c.net/2", canonical="http://c.net/1"), page(15, "http://c.net/3", canonical="http://x.com/de/3"), page(16, "http://c.net/2", refresh="3"),
        page(17, "http://x.com/de/1", canonical="http://org/de"), page(18, "http://org"), page(19, "x://y://com/de/z"), page(5, "http://x.com/en/1"),
        page(20, "http://d.net/?a=1&b=2", canonical="http://d.net/t"), page(21, "http://d.net/t#frag", canonical="http://x.com/de/4"),
        (22, "http://e.net/", None, 1, None, None), (None, "http://x.com/de/1", "", 1, None, None),
    ]
    got = uf.judge_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.rule, r.verdict, r.via) for r in got}
    assert by[1] == ("example.org/es/", "block", "rule") and by[2] == ("example.org/en/1", "block", "rule")
    assert by[3] == ("com/fr/", "allow", "rule") and by[4] == ("com/de/", "block", "rule") and by[5] == (None, "allow", "default")
    assert all(by[i] == (None, "allow", "default") for i in (6, 7, 8, 9, 10, 18, 22))
    assert by[11] == by[12] == by[20] == by[21] == (None, "block", "alias")
    assert by[13] == by[14] == by[15] == by[16] == (None, "allow", "default")  # an allowed alias takes precedence
    assert by[None] == by[4]
    hosts = {r.page_id: (r.host, r.path) for r in got}
    assert hosts[2] == ("a.example.org", "/en/12") and hosts[8] == hosts[9] == hosts[10] == ("", "") and hosts[18] == ("org", "") and hosts[19] == ("y:", "//com/de/z")


def test_given_edges_and_empty(spark):
    df = spark.createDataFrame([page(1, "http://a.net/x"), page(2, "http://x.com/de/1")], SCHEMA)
    edges = spark.createDataFrame([("http://a.net/x", "http://x.com/de/1"), (None, "http://z.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in uf.judge_pages(df, edges=edges).collect()} == {1: "block", 2: "block"}
    assert uf.judge_pages(df.limit(0)).count() == 0


def test_against_sql(spark, tmp_path):
    assert_same(spark, uf.op1_url_filter(spark, SF), uf.OP1_SQL, SF)
    rng = random.Random(9)
    url = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(['a.', '', 'WWW.'])}ex{rng.randrange(3)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['de', 'fr', 'x'])}/{rng.randrange(9)}{rng.choice(['', '?q=1', '#f'])}"
    rows = [page(i, url(), url() if rng.random() < 0.4 else None, rng.choice([None, None, "/de/3", "4"])) for i in range(120)]
    spark.createDataFrame(rows, SCHEMA).select("page_id", "url", "html").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert_same(spark, uf.op1_url_filter(spark, str(tmp_path)), uf.OP1_SQL, str(tmp_path))
