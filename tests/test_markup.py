"""The allow list and the tree of documents."""

import random

import pytest

from colloquy.functions import markup as M


@pytest.mark.parametrize(("html", "want"), [
    ("<p onclick=x>a<b>c</p>", "<p>a<b>c</p>"), ("<script>a</script>b", "b"), ("<iframe><p>x</p></iframe><p>y</p>", "<p>y</p>"), ('<a href="javascript:a">x</a>', "<a>x</a>"), ('<a href="HTTPS://e.org">x</a>', '<a href="HTTPS://e.org">x</a>'),
    ("a &lt;b&gt; &amp; c", "a &lt;b&gt; &amp; c"), ("<br/><hr>", "<br><hr>"), ("<style>p{}</style><style>q", ""), ("<custom>t</custom>", "t"), ("</script>t", "t"), ('<div data-type="detailsContent" id=1>t</div>', '<div class="editor-details-content" data-type="detailsContent">t</div>'),
    ('<mention-component id="00000000-0000-0000-0000-000000000001" entity_identifier="00000000-0000-0000-0000-000000000002" entity_name="user_mention">x</mention-component>', '<mention-component id="00000000-0000-0000-0000-000000000001" entity_identifier="00000000-0000-0000-0000-000000000002" entity_name="user_mention">x</mention-component>'),
    ('<mention-component id="1">x', "x"), ("<p data-participants='[\"A&B\"]'>x", '<p data-participants="[&quot;A&amp;B&quot;]">x'), ("<p data-participants='{}'>x", None), (None, None), ("", ""), ("a" * (1 << 20), "a" * (1 << 20)), ("é" * (1 << 20), None), ("<a href='http://[x'>y", "<a>y"),
])
def test_allow_list(html, want):
    assert M.rewritten(html) == want


@pytest.mark.parametrize("seed", range(50))
def test_rewriting_twice_changes_nothing(seed):
    r = random.Random(seed)
    parts = ["<p>", "</p>", "<script>", "</script>", "<a href='https://x?a=1&b=\"2\"'>", "</a>", "text & more", "<", "&lt;", "<object>", "</object>", "<br>", "<!-- c -->", "<div data-type=detailsContent>", "</div>", "<details data-id=\"transcript-" + "a" * 32 + "\">", "\"'", "<p/>", "<![CDATA[x]]>"]
    once = M.rewritten("".join(r.choices(parts, k=30)))
    assert M.rewritten(once) == once
    assert not any(f"<{t}" in once for t in M.HIDDEN)


def test_generated_parts_go_and_edits_stay():
    clean = lambda h, title="T": M.without_generated(h, title, "People:", "Timecodes", ["a"], ["b"])
    assert clean("<h1> T </h1>x<p>People: A</p><div><h1>T</h1></div>") == "x<div><h1>T</h1></div>"
    assert clean("<h2>Timecodes</h2> <p></p><ul><li>1</li></ul><ul>2</ul>") == " <p></p><ul>2</ul>"
    assert clean("<h2>Timecodes</h2><p>mine</p><ul>1</ul>") == "<p>mine</p><ul>1</ul>"
    assert clean('<attachment-component src="a"></attachment-component><div data-id="b">x</div><div data-id="c">y &amp; z</div>') == '<div data-id="c">y &amp; z</div>'
    assert clean("<h1>T</h1>", None) == "<h1>T</h1>" and clean(None) is None
    assert clean("<div>" * 5000 + "x").count("</div>") == 5000


def test_documents_come_back_from_their_markdown(spark):
    from pyspark.sql import functions as F

    from colloquy.sources import formats as Z

    texts = ["plain", "two\nlines", "back\\slash", "a \\n b", "- [#](#x)", "[#](#y)", "## no heading", "", None, "\u0001 \\1 \r", "end\\", " spaces  "]
    rows = [(d, s, k, p, t, x) for d in (1, 2) for k, s in enumerate(["B \\ [x]", "A\nA"]) for p, (t, x) in enumerate(zip(texts, ["t1", None] * 6, strict=True))]
    items = spark.createDataFrame(rows, "doc int, section string, section_place int, place int, text string, target string")
    docs = Z.render_documents(items, ["doc"], F.concat(F.lit("T [1]\n"), F.col("doc")))
    assert docs.count() == 2
    got = sorted((tuple(x) for x in Z.parse_documents(docs, ["doc"]).collect()), key=str)
    assert got == sorted([(d, f"T [1]\n{d}", s, p, t or "", x) for d, s, _, p, t, x in rows], key=str)
    odd = spark.createDataFrame([(1, "- before any heading\n## S\ntext\n- one\n\n- two [#](#t)\n## S\n- again"), (2, ""), (3, None)], "doc int, document string")
    assert sorted((x["section"], x["place"], x["text"], x["target"]) for x in Z.parse_documents(odd, ["doc"]).collect()) == [("S", 0, "again", None), ("S", 0, "one", None), ("S", 1, "two", "t")]
