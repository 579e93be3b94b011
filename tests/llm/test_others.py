"""Chats, nearest neighbours, URL filters and HTML extraction."""

import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import ann, chat, html_text, queries, url_filter

SF = "/root/testdata/sf0.001"


def test_chat_links_orders_and_validates(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "search", "arguments": {"query": "x", "limit": "3"}, "depends_on": ["a"]}, {"id": "a", "name": "calculate", "arguments": '{"expression": "1+1"}'}]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "2"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "2"})),
        (1, 4, "assistant", '{"tool_calls":[{"id":"c","name":"nope","arguments":[1],"depends_on":["d"]},{"id":"d","name":"fetch","arguments":{"headers":{}},"depends_on":["c"]}]}'),
        (1, 5, "tool", '{"tool_call_id":"a","content":"again"}'),
        (None, None, None, None), (2, 0, "tool", "{bad"), (2, 0, "tool", "{bad"), (2, 1, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"z"}}]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", F.lit("clash"))
    got = chat.format_chats(df).orderBy("conv_id", "at", "level", "place", "step").collect()
    status = {(r.conv_id, r.kind, r.call_id, r.turn): (r.status, r.errors) for r in got}
    assert status[1, "call", "a", 1] == ("ok", []) and status[1, "call", "b", 1] == ("invalid", ["type of limit"])
    assert status[1, "call", "c", 4] == ("cyclic", ["unknown tool"]) and status[1, "call", "d", 4] == ("cyclic", ["missing url"])
    assert status[1, "result", "a", 2][0] == "ok" and status[1, "result", "a", 5][0] == "repeated" and status[1, "result", "zz", 3][0] == "orphan"
    assert status[2, "call", "a", 1] == ("unanswered", [])
    order = [(r.kind, r.call_id) for r in got if r.conv_id == 1]
    assert order.index(("call", "a")) < order.index(("call", "b")) and order.index(("call", "a")) < order.index(("result", "a"))
    assert sum(r.conv_id == 2 and r.kind == "message" for r in got) == 3
    assert all(json.dumps(json.loads(r.json), separators=(",", ":"), sort_keys=True, ensure_ascii=False) == r.json for r in got)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = sorted((r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role, "turn": r.turn}, separators=(",", ":"), ensure_ascii=False)) for r in rows)
    assert sorted((r.conv_id, r.turn, r.json) for r in chat.format_chats(spark.read.parquet(f"{SF}/conversations.parquet")).collect()) == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    got, sql = queries.op3_chat_format(spark, SF), c.sql(chat.ORACLE)
    names = ", ".join(f'"{c}"' for c in got.columns)
    plain = lambda rows: sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)
    assert plain(got.collect()) == plain(c.sql(f"SELECT {names} FROM ({chat.ORACLE})").fetchall()) and sorted(sql.columns) == sorted(got.columns)


def test_chat_order_of_generated_call_graphs(spark):
    """Against a plain topological sort: levels are longest chains, cycles and what hangs on them have none."""
    rnd, rows, graph, turns = random.Random(8), [], {}, {}
    for conv in range(12):
        for k in range(12):
            calls = []
            for j in range(rnd.randrange(1, 3)):
                name = f"c{k}.{j}"
                needs = sorted({f"c{rnd.randrange(max(1, k + (2 if rnd.random() < 0.1 else 0)))}.{rnd.randrange(2)}" for _ in range(rnd.randrange(3))})
                calls.append({"id": name, "name": "calculate", "arguments": {"expression": "1"}, "depends_on": needs})
                graph[conv, name], turns[conv, name] = needs, k
            rows.append((conv, k, "assistant", json.dumps({"tool_calls": calls})))
    want: dict = {}
    for _ in range(len(graph)):
        for (conv, name), needs in graph.items():
            needs = [(conv, n) for n in needs if (conv, n) in graph]
            if (conv, name) not in want and all(n in want for n in needs):
                want[conv, name] = (max([turns[conv, name], *(want[n][0] for n in needs)]), max([0, *(want[n][1] + 1 for n in needs)]))
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert len(got) == len(graph) and 0 < len(want) < len(graph)
    assert {(r.conv_id, r.call_id): (r["at"], r.level) for r in got if r.status != "cyclic"} == want


def test_chat_nested_schemas_and_numbers(spark):
    tools = {"t": {"type": "object", "properties": {"a": {"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}, "l": {"type": "array", "items": {"type": "string", "enum": ["x", "y"]}}, "e": {"enum": [1, "1", {"k": 2}]}}, "required": ["a"]}}
    cases = {
        '{"a":{"n":1.0},"l":["x","y"],"e":1.0}': [], '{"a":{"n":1e2}}': [], '{"a":{"n":1.5},"e":"1"}': ["type of a.n"], '{"a":{},"l":["x","z",3],"e":{"k":2}}': ["missing a.n", "type of l[]", "value of l[]"],
        '{"a":[],"l":{},"e":2}': ["type of a", "type of l", "value of e"], '{"a":{"n":0,"z":1},"q":null}': ["unexpected a.z", "unexpected q"], "[]": ["arguments are no object"], '"{\\"a\\":{\\"n\\":3}}"': [], "{}": ["missing a"],
    }
    rows = [(1, k, "assistant", '{"tool_calls":[{"id":"c%d","name":"t","arguments":%s}]}' % (k, a)) for k, a in enumerate(cases)]
    got = {r.turn: r.errors for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools).where("kind = 'call'").collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    numbers = {"1.0": "1", "1e2": "100", "-0.0": "0", "0": "0", "1.50": "1.5", "1E-3": "0.001", "123456789.25": "123456789.25", "1e21": "1e+21", "1.5e300": "1.5e+300", "0.000001": "0.000001", "1e-7": "1e-7", "12345678901234567890": "12345678901234567890", "-2.5E+3": "-2500"}
    df = spark.createDataFrame([(k, "[%s,\"%s \\\"1.0\"]" % (k, k)) for k in numbers], "k string, t string")
    assert {r.k: r.j for r in df.select("k", chat.canonical_numbers(F.col("t")).alias("j")).collect()} == {k: "[%s,\"%s \\\"1.0\"]" % (v, k) for k, v in numbers.items()}


def test_nearest_of_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [0.0, 3.0]), (7, [1.0]), (None, [1.0, 1.0]), (40, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []
    twice = spark.createDataFrame([(20, [1.0, 0.0]), (20, [3.0, 0.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(twice, F.col("vec_id") % 20 == 0, k=1).collect())) == [(20, 1, 1, 6.0), (20, 1, 20, 3.0)]


def test_tree_shape_follows_the_table():
    assert ann.shape(1) == (2, 1) and ann.shape(10_000) == (3, 1) and ann.shape(100_000) == (5, 2) and ann.shape(10**12) == (12, 3)


def test_nearest_recall(spark):
    d = "/root/testdata/sf0.01"
    x = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    m, ids = np.stack(x.embedding.to_numpy()).astype(float), x.vec_id.to_numpy()
    got = queries.op5_nearest(spark, d).toPandas()
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        s[i] = -np.inf
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        hit, n = hit + len(set(own.vec_id) & set(ids[np.lexsort((ids, -s))[:20]])), n + 20
    assert hit / n >= 0.9


def test_url_filter_matches_its_oracle(spark):
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    names = "page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_odds"
    assert sorted(map(tuple, queries.op7_url_filter(spark, SF).select(*names.split(", ")).collect())) == sorted(c.sql(f"SELECT {names} FROM ({queries.OP7_SQL})").fetchall())


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "x.com:8080": ("x.com", "x.com", "com"), "me:pw@www.x.org": ("www.x.org", "x.org", "org"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "<address>"), "[::1]:8": ("[::1]", "[::1]", "<address>"), "": ("", "", ""), "co.com": ("co.com", "co.com", "com")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: tuple(r)[1:] for r in df.select("host", *url_filter.registered(F.col("host"))).collect()} == hosts


def test_beta_below_is_the_integral():
    for a, b, x in ((0.3, 4.0, 0.5), (2.0, 2.0, 0.5), (30.5, 11.0, 0.5), (900.0, 700.0, 0.5), (5.0, 1.5, 0.9), (1e-9, 5.0, 0.5)):
        drawn = np.random.default_rng(1).beta(a, b, 400_000)
        assert abs(url_filter.beta_below(np.array([a]), np.array([b]), x)[0] - (drawn <= x).mean()) < 0.004


def test_url_filter_of_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.COM/en/x?y"), (4, "https://example.com/en/7#z"), (5, "x://example.net/de/81"), (6, "x://notexample.net/de/8"), (7, "ftp://org"), (7, "ftp://org"), (8, "http://bad.test/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(8, 1)] * 400 + [(1, 0)] * 400 + [(3, None)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.com", "/en/x", "com/en/", "block"), 4: ("example.com", "/en/7", "example.com/en/7", "allow"), 5: ("example.net", "/de/81", "example.net/de/8", "block"),
        6: ("notexample.net", "/de/8", "net/de/", "allow"), 7: ("org", "", None, "allow"), 8: ("bad.test", "/", None, "block"),
    }
    assert url_filter.judge_urls(pages, outcomes).count() == len(rows)
    assert url_filter.judge_urls(pages.limit(0), outcomes).collect() == []


PAGES = [
    (None, ""), ("", ""), ("<p>x", "x"), ("just text", "just text"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p><b>A\n b<br><p>c&nbsp;d</article><footer>f</footer>", "T & t\nA b\nc d"),
    ("<body><header>Site</header><div id=sidebar><p>side text that is long enough to look dense</div><div class=post><h1>Title</h1><p>Long text of the article goes on here.<p>And on.</div><div class=comments><p>me too</div>", "Title\nLong text of the article goes on here.\nAnd on."),
    ("<article><header><h1>H</h1><p>by me</p></header><ul><li>x<li>y</ul><script>var a='<p>no</p>'</script><form><p>name</form><aside>no</aside></article>", "H\nx\ny"),
    ("<html><head><title>t</title><style>p{}</style></head><body><div hidden>h</div><main><p>only</p><div class='cookie-notice'>ok?</div></main></body></html>", "only"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


P1, P2 = "A long paragraph of the article that says what it has to say, at some length. " * 3, "Another paragraph that goes on about the same matter, with many more words. " * 3
NAMED = [
    (f"<body><nav><a href=/>Home</a></nav><div class='content has-sidebar'><article><h1>T</h1><p>{P1}</p></article></div></body>", ["T", P1]),
    (f"<body><div id='page-with-menu'><div class=menu><a href=/a>A</a> <a href=/b>B</a></div><div class=post><h1>T</h1><p>{P1}</p><p>{P2}</p></div></div></body>", ["T", P1, P2]),
    (f"<body><article><h1>T</h1><p>{P1}</p><h2 id='side-effects'>Side effects</h2><p>{P2}</p><section id='related-work'><h2>Related work</h2><p>Few have done it.</p></section><section id='search-results'><h2>Results</h2><p>{P1}</p></section></article></body>", ["T", P1, "Side effects", P2, "Related work", "Few have done it.", "Results", P1]),
    (f"<body><article><h1>T</h1><p>{P1}</p><div class='related'><h3>More</h3><a href=/a>A headline of another page</a></div><div class='comments'><h3>Comments</h3><p>me too</p></div></article></body>", ["T", P1]),
    (f"<body><main><p><a href=/a>Sign in</a></p><p><a href=/b>Help</a></p></main><div class=post><h1>T</h1><p>{P1}</p><p>{P2}</p></div></body>", ["T", P1, P2]),
]


@pytest.mark.parametrize("html,text", NAMED)
def test_names_are_hints_only(html, text):
    assert html_text.main_text(html) == "\n".join(t.strip() for t in text)


def plain_choice(html):
    """The text of the chosen subtree by a second, recursive implementation of the same formula."""
    root = html_text.Tree(html).root
    blank = re.compile(r"\s+")

    def kids(n):
        return [c for c in n.children if not isinstance(c, str)]

    def chars(n):
        return sum(len(blank.sub(" ", c).strip()) if isinstance(c, str) else chars(c) for c in n.children)

    def count(n, tag=None):
        return sum((tag in (None, k.tag)) + count(k, tag) for k in kids(n))

    def linked(n):
        return chars(n) if n.tag == "a" else sum(map(linked, kids(n)))

    def density(n):
        c = chars(n)
        if not c:
            return 0.0
        t, lc, lt = max(1, count(n)), max(1, linked(n)), max(1, count(n, "a"))
        base = math.log(c / max(1, c - linked(n)) * lc + linked(root) / max(1, chars(root)) * c + math.e)
        return c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base)

    def total(n):
        return sum(density(k) for k in kids(n) if k.tag not in html_text.INLINE) or density(n)

    every, todo = [], [root]
    while todo:
        n = todo.pop(0)
        every.append(n)
        todo += kids(n)
    body = next((n for n in every if n.tag == "body"), root)
    path = lambda n: [n] if n is body or n.parent is None else [n, *path(n.parent)]
    some = [n for n in every if chars(n) and n.tag not in html_text.INLINE and n.tag not in ("html", "body", "#root")]
    if not some:
        return " ".join(html_text.blocks(body, whole=True))
    least = min(density(n) for n in path(max(some, key=lambda n: (density(n), chars(n)))))
    best = max((n for n in some if density(n) >= least * (1 - 1e-12)), key=lambda n: (round(total(n), 9), chars(n)))
    wide = [n for n in path(best) if density(n) >= density(body) * (1 - 1e-12) and n.tag not in ("html", "body", "#root")]
    return " ".join(html_text.blocks((wide or [best])[-1], whole=True))


def test_density_chooses_without_names(spark):
    """Pages whose article and main elements are plain divisions, without class or id: the formula alone decides."""
    pages, same, named = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()], 0, 0
    for html in pages:
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"<(/?)(article|main|section)\b", r"<\1div", html))
        got = html_text.main_text(bare)
        same += got.replace("\n", " ") == plain_choice(bare)
        named += got == html_text.main_text(html)
    assert same == len(pages) and named >= 0.9 * len(pages)


def test_extraction_job(spark):
    df = spark.createDataFrame([(k, None, h) for k, (h, _) in enumerate(PAGES)] + [(0, "u", None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract_main_text(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(k, t, len(t)) for k, (_, t) in enumerate(PAGES)] + [(0, "", 0)])
    assert html_text.extract_main_text(df.limit(0)).collect() == []
