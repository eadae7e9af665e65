import duckdb

import __spark_entry__ as entry


def test_links_of_long_pages_are_all_counted(spark, tmp_path):
    html = "<html><body><h1>All</h1>" + "".join(f'<p><a href="/p/{i}">{"" if i % 10 == 0 else f"Page {i}"}</a></p>' for i in range(450)) + "</body></html>"
    rows = [(1, "https://example.com/", html), (2, "https://example.com/2", '<a href="/">Home</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["page_links"](spark, str(tmp_path)).select("page_id", "links", "named").collect())
    assert got == [(1, 450, 405), (2, 1, 1)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT page_id, links, named FROM ({entry.oracle_sql()['page_links']})").fetchall())
    elements = entry.queries()["page_elements"](spark, str(tmp_path))
    assert elements.where("page_id = 1").count() == 200


def test_pages_in_sql(spark):
    """The table function gives the nodes that parse_pages gives, each page parsed once."""
    from collections import Counter

    from pagewarden.operators import pages

    html = '<p id="a">One</p><p id="b">Two</p><a href="/x" aria-labelledby="b gone a">link</a><label for="f">Name</label><input id="f"><script>no</script>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<h1>Title &amp; more</h1>")], "page_id long, html string")
    pages.register_sql(spark)
    got = spark.sql("SELECT p.page_id, n.* FROM {p} p, LATERAL page_nodes(p.html) n", p=df)
    nodes = pages.parse_pages(df)
    rows = lambda d: Counter(str(r) for r in d.select(*nodes.columns).collect())
    assert rows(got) == rows(nodes)
    table = {r["role"]: r["label"] for r in pages.element_table(got).where("page_id = 1").collect()}
    assert table == {"link": "Two One", "textbox": "Name"}
    assert pages.element_table(nodes)._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
