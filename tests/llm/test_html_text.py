import random

from llm.html_text import extract_text, visible_text


def test_blocks_lists_and_hidden_parts():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>bold</b>  word<p>Two<br>lines
    <ul><li>a<li>b <ol start=3><li>c<li>d</ol><li>e</ul><div hidden>no</div><div style="color:red; display : none">no</div>
    <script>if (a<b) "</p>"</script><template>no</template><!-- no --><pre>  x
   y</pre>tail &amp; 3 < 4</body></html>"""
    assert visible_text(page).split("\n") == [
        "Head", "", "One bold word", "", "Two", "lines", "", "- a", "- b", "  3. c", "  4. d", "- e", "", "  x", "   y", "", "tail & 3 < 4"]


def test_table_cells_are_aligned():
    page = "<table><thead><tr><th>Name<th>N<tbody><tr><td>Long name<td>1<td>z<tr><td colspan=2>wide<td>q</table>after"
    assert visible_text(page).split("\n") == ["Name       N", "Long name  1  z", "wide          q", "", "after"]
    assert visible_text("<table><td>a<table><tr><td>in<td>ner</table><td>b</table>") == "a in  ner  b"
    long = "x" * 100
    assert visible_text(f"<table><tr><td>{long}<td>1<tr><td>s<td>2</table>").split("\n") == [f"{long}  1", "s  2"]


def test_broken_markup_never_fails_and_stays_linear():
    rng = random.Random(8)
    bits = ["<", ">", '"', "'", "<p>", "</td>", "<td>", "<table>", "</table>", "<li>", "<ul>", "<!--", "-->", "=", "x ", "<script>", "</p>",
            "<tr>", "<br", "&amp", "</ul>", "<!", "<pre>", "</", "<ol start=z>"]
    for _ in range(2000):
        visible_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert visible_text("<a " * 100_000).startswith("<a <a")
    assert visible_text("<i>" + "word " * 100_000).count("word") == 100_000


def test_query_edges(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "plain", "u"), (3, "plain", "u"), (None, "<p>x<p>y", "u")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text, r.n_lines, r.n_chars) for r in extract_text(frame).collect()), key=str)
    assert got == sorted([(1, "", 0, 0), (2, "", 0, 0), (3, "plain", 1, 5), (3, "plain", 1, 5), (None, "x\n\ny", 2, 4)], key=str)
    assert extract_text(frame.limit(0)).count() == 0
