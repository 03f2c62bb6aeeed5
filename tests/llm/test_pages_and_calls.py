"""Page extraction, tool calls and the pipeline."""

from __future__ import annotations

import html
import json
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logsift.llm import extract, queries, toolcalls
from tests.llm import brute

LONG = "The weather in the north of the country is as it was on the day that they left for the coast, and it will be so for some time to come yet."
PAGES = [
    (f"<body><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>{LONG}<p>Short.<br>one</article><footer>&copy; us</footer>", f"A & B\n{LONG}\nShort. one"),
    (f"<article><p>Hi.</p></article><div class='sidebar'><p>{LONG}</p></div>", "Hi."),
    (f"<main><p>{LONG}</p><form><p>Subscribe {LONG}</p></form><div class=\"ad-box\">{LONG}</div><p>End.</p></main>", f"{LONG}\nEnd."),
    (f"<article><p>{LONG}</p><section id=comments><article><p>{LONG} reader</p></article></section></article>", LONG),
    (f"<div><p>{LONG}</p><p>Yes.</p><ul><li><a href=a>one link</a></li><li><a href=b>two links</a></li></ul></div>", f"{LONG}\nYes."),
    (f"<script>var a='<p>{LONG}</p>'</script><style>p{{}}</style><article><p>x &lt; y \n\t z&nbsp;w</p><!-- <p>no</p> --></article>", "x < y z w"),
    ("<article><p>cut <a href='x", "cut"),
    ("<article></article><p>out</p>", ""),
    (None, ""), ("", ""), ("no tags", ""), ("<<<>>>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(
    "opening, kept",
    [
        ("article class='post comments-open'", True), ("main class='no-sidebar'", True), ("div class='content has-sidebar'", True),
        ("div class='wrapper with-sidebar'", True), ("div role=main class='main-menu-wide'", True), ("section id=content class='share-buttons_above'", True),
        ("article class='comment'", False), ("div class='content sidebar'", False), ("div class='post-comments'", False), ("div class='sidebar-left'", False),
    ],
)
def test_names_of_parts_do_not_hide_an_article(opening, kept):
    assert extract.main_text(f"<body><{opening}><p>{LONG}</p><p>{LONG}</p></{opening.split()[0]}></body>") == (f"{LONG}\n{LONG}" if kept else "")


def test_extract(spark):
    rows = [(i, "u", p, "old", 3) for i, (p, _) in enumerate(PAGES)] * 2 + [(99, None, f"<article>{'<p>word' * 50_000}", None, None)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r.page_id][1] if r.page_id < 99 else "\n".join(["word"] * 50_000)
        assert r.text == want and r.n_chars == len(want)


def test_second_pass_inherits():
    block = lambda: extract.Block("x", 0, False, -1)
    labels = [1, 0, 0, -1, 0, 1, 0]
    assert extract.second_pass([block() for _ in labels], labels) == [True, True, False, False, True, True, True]


def plain_article(page):
    """The text of a well-formed page's article, by patterns."""
    body = re.sub(r"<!--.*?-->|<(script|style|aside|form)\b.*?</\1>", "", page.split("<article>")[1].split("</article>")[0], flags=re.S)
    blocks = [re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)) for x in re.split(r"</?(?:p|h[1-6]|ul|ol|li|table|tr|td|th|div|section|blockquote|pre)\b[^>]*>", body)]
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in blocks) if t)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_articles_of_the_given_pages(spark, folder):
    sf = f"/root/testdata/{folder}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op5_extract(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        want = plain_article(pages[r.page_id].html)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


@pytest.mark.parametrize(
    "piece", ["<script ", '<a "', "<li ", "<div>", "</div>", "<!--", "<!--x", "<", "<a '\">", '<p class="a', "<div></p>", "&#1", "</script ", "<body><head>", "<article>", "<a>x", "<section id='"]
)
def test_a_megabyte_of_broken_markup_takes_linear_time(piece):
    for page in (piece * (1_000_000 // len(piece)), "<article>hi" + piece * (1_000_000 // len(piece)) + ">"):
        start = time.process_time()
        extract.main_text(page)
        assert time.process_time() - start < 6  # 2 s on an idle machine


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>a <b title=\"x > y\">b</b> c</article>", "a b c"), ("<article><p>a <b title=\"x > y>b</b> c</article>", "a y>b c"),
        ("<article><p>n &#" + "9" * 5000 + "; &#x" + "f" * 5000 + ";</article>", "n \ufffd \ufffd"), ("<article>1 < 2 <3 </ x> <!doctype a><?php b?>c<p>d <i", "1 < 2 <3 </ x> c\nd"),
        ("<article>a<div>b<section>c</div>d</article>e<p>f", "a\nb\nc\nd"), ("<head><nav><body><article>x<nav>y</nav></article>", ""), ("<head><title>t<article>x</title><body><main>z", "z"),
    ],
)
def test_odd_markup(page, text):
    assert extract.main_text(page) == text


def calls(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, after string").withColumn("level", F.lit("clash"))


def test_link(spark):
    made = [
        (1, "a", 1, "search", '{"query": "x\\u00e9", "limit": 2.0}', None), (1, "a", 5, "search", "{}", None), (1, "b", 3, "search", '{"limit": 9}', "a"),
        (1, "c", 4, "search", "[1]", "b"), (1, "d", 4, "nope", "{", "gone"), (2, "x", 1, "search", '{"query": "q", "query": "r", "limit": 1}', "y"),
        (2, "y", 2, "search", '{"query": "q", "limit": NaN}', "x"), (2, "z", 3, None, None, "y"), (None, "a", 1, "search", "{}", None), (3, None, 1, "search", "{}", None),
        (4, "s", 4, "search", '{"query": "\\ud800", "limit": 1e999}', None), (4, "t", 4, "search", '{"query": "\\ud800", "limit": 1}', "s"),
    ]
    made += [(7, f"n{i}", i, "search", '{"query": "q", "limit": 1}', f"n{i - 1}" if i else None) for i in range(70)]
    answers = [(1, "a", 2, 'say "hi"\n'), (1, "a", 9, "again"), (1, "q", 6, None), (2, "y", 1, ""), (4, "s", 1, "early"), (None, "a", 1, "x")]
    results = spark.createDataFrame(answers, "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls(spark, made), results, queries.TOOLS).collect()}
    assert len(got) == 11 - 1 + 70 and (None, "a") not in got
    a = got[1, "a"]
    assert (a.level, a.status, a.n_calls, a.n_results, a.errors) == (0, "linked", 2, 2, [])
    assert a.json == '{"arguments":{"limit":2,"query":"xé"},"call_id":"a","name":"search","result":"say \\"hi\\"\\n"}'
    assert got[1, "b"].level == 1 and got[1, "b"].errors == ["$.query: missing", "$.limit: above 5"] and got[1, "c"].level == 2
    assert got[1, "c"].errors == ["arguments: no object"] and got[1, "q"].status == "result without call"
    assert got[1, "d"].errors == ["arguments: not valid JSON", "name: unknown tool"] and got[1, "d"].level == 0
    assert [got[2, k].level for k in "xyz"] == [None, None, None] and got[2, "y"].status == "cycle"
    assert got[2, "x"].errors == ["arguments: repeated key"] and got[2, "y"].errors == ["arguments: not valid JSON"]
    assert got[4, "s"].status == "result before call" and got[4, "s"].errors == ["arguments: not valid JSON"] and "\\ud800" in got[4, "t"].json
    assert [got[7, f"n{i}"].level for i in range(70)] == list(range(70))
    for r in got.values():
        assert toolcalls.canonical(json.loads(r.json)) == r.json
    assert toolcalls.link(calls(spark, []), results.limit(0), {}).count() == 0


@pytest.mark.parametrize(
    "value, schema, errors",
    [
        (None, {"type": ["string", "null"]}, []), (1, {"type": ["string", "null"]}, ["$: not of type string or null"]), (2.0, {"type": "integer"}, []), (True, {"type": "integer"}, ["$: not of type integer"]),
        (True, {"enum": [1]}, ["$: not one of the allowed values"]), ([1.0], {"enum": [[1]]}, []), ({"a": True}, {"const": {"a": 1}}, ["$: not the given value"]), ("ab", {"pattern": "^b"}, ["$: does not match"]),
        ({"x": {"y": 1}}, {"additionalProperties": {"additionalProperties": {"type": "string"}}}, ["$.x.y: not of type string"]), ({"x": 1}, {"properties": {"x": False}}, ["$.x: not allowed"]),
        ([], {"minItems": 1}, ["$: too short"]), ("abc", {"maxLength": 2}, ["$: too long"]), ("a", {"anyOf": [{"type": "null"}, {"minLength": 2}]}, ["$: fits none of the alternatives"]), (3, {"type": "tuple"}, ["$: not of type tuple"]),
    ],
)
def test_schemas(value, schema, errors):
    assert toolcalls.problems(value, schema) == errors


def test_unchecked_words_and_depth(spark):
    schema = {"type": "object", "properties": {"x": {"$ref": "#/y", "title": "X"}, "z": {"items": {"type": ["null", "odd"]}}}, "anyOf": [{"oneOf": []}]}
    assert toolcalls.unchecked(schema) == ["$.x: unknown schema word $ref", "$.z[]: unknown type odd", "$: unknown schema word oneOf"]
    deep = '{"a":' * 1500 + "1" + "}" * 1500
    made = [(1, "a", 1, "t", deep, None), (1, "b", 2, "t", '{"x": "[[{\\""}', None), (1, "c", 3, "t", "[" * 100_000, None), (1, "d", 4, "t", '{"x":' * 199 + "{}" + "}" * 199, None)]
    got = {r.call_id: r for r in toolcalls.link(calls(spark, made), spark.createDataFrame([], "conv_id long, call_id string, turn long, content string"), {"t": schema}).collect()}
    blind = [f"schema {p}" for p in toolcalls.unchecked(schema)]
    assert got["a"].errors == ["arguments: nested too deep"] == got["c"].errors and '"arguments":null' in got["a"].json
    assert got["b"].errors == blind and got["d"].errors == blind and got["d"].json.count("{") == 201


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = docs.count()
        docs = step(spark, docs, sf)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert 0 < len(rows) <= before
        assert docs.columns[: len(columns)] == columns and (name == "mix" or docs.columns == columns)
    assert all(r.taken > 0 for r in rows)


def test_pipeline_stages_match_plain_python(spark, sf):
    """Each stage after the first on its own input, against the brute-force versions."""
    stages, items = dict(corpus_pipeline.STAGES), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    step = lambda name, rows: sorted(stages[name](spark, spark.createDataFrame(rows, docs.schema), sf).collect(), key=repr)
    rows = docs.collect()
    found = step("line_dedup", rows)
    edited = brute.without_copies([(r.doc_id, r.text) for r in rows], 50)
    want = [(r.doc_id, edited[r.doc_id, r.text]) for r in rows]
    assert [(r.doc_id, r.text) for r in found] == sorted([w for w, r in zip(want, rows, strict=True) if brute.WORD.search(w[1]) or w[1] == r.text], key=repr)
    rows, found = found, step("near_dedup", found)
    groups = brute.components([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
    words = {tuple(brute.WORD.findall(r.text.lower())) for r in rows if r.doc_id is not None}
    alone = {tuple(brute.WORD.findall(r.text.lower())) for r in rows if r.doc_id is None} - words
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == sorted({d for d, (_, c) in groups.items() if d == c}) and len([r for r in found if r.doc_id is None]) == len(alone)
    rows, found = found, step("decontamination", found)
    bad = {d for d, *_ in brute.contained([(i, r.text) for i, r in enumerate(rows)], items)}
    assert found == sorted([r for i, r in enumerate(rows) if i not in bad], key=repr)
    rows, mixed = found, step("mix", found)
    per, order = {}, sorted({r.source for r in rows})
    for r in rows:
        per[r.source] = per.get(r.source, 0) + len(brute.WORD.findall(r.text))
    assert {r.source: r.source_size for r in mixed} == per and order
    for s in order:
        mine = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 and all(r.taken <= 3 * r.size for r in mine)
    assert abs(sum({r.source: r.target for r in mixed}.values()) - sum(per.values())) < 1e-6


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "12 34", None, None, 5), (3, LONG, "en", "a", 3), (3, LONG, "en", "a", 3), (None, LONG + " x", "en", "", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    items = [(1, None), (2, "")]
    for i, found in enumerate((rows, [])):
        spark.createDataFrame(found, schema).write.parquet(str(tmp_path / f"{i}/documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / f"{i}/benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / str(i))).collect()
        assert {r.text for r in got} <= {r[1] for r in found}
    assert got == []
