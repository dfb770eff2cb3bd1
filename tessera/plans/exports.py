"""Documents and answers as Markdown, HTML, plain text and prompt files, made by expressions and written one file a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import table

CODE = ["code_block", "codeBlock"]


def _or(c: Column, default: str) -> Column:
    """``c``, or the default for null and empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))


def node_text(node: Column) -> Column:
    """What a block says: a callout's title above its content, a table's caption, an image's caption or description, else the content."""
    title, content, caption, alt = (_trimmed(node[f]) for f in ("title", "content", "caption", "alt"))
    callout = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(content, F.lit("")))
    table_text = _or(_trimmed(F.coalesce(F.nullif(node["caption"], F.lit("")), node["content"])), "Table")
    image = F.coalesce(F.nullif(caption, F.lit("")), F.nullif(alt, F.lit("")), F.lit("Image"))
    return F.when(node["type"] == "callout", callout).when(node["type"] == "table", table_text).when(node["type"] == "image", image).otherwise(content)


def _language(node: Column) -> Column:
    return _or(_trimmed(node["language"]), "text")


def _is_image(node: Column) -> Column:
    return F.coalesce((node["type"] == "image") & (node["src"] != ""), F.lit(False))


def _markdown_block(node: Column) -> Column:
    text, code = node_text(node), F.coalesce(node["content"], F.lit(""))
    fenced = F.concat(F.lit("```"), _language(node), F.lit("\n"), code, F.when(code != "", "\n").otherwise(""), F.lit("```"))
    caption = F.concat(F.lit("\n*"), _trimmed(node["caption"]), F.lit("*"))
    image = F.concat(F.lit("!["), _trimmed(_or(node["alt"], "Image")), F.lit("]("), node["src"], F.lit(")"), F.when(_trimmed(node["caption"]) != "", caption).otherwise(""))
    quoted = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")
    shown = F.when(node["type"].isin(CODE), fenced).when(_is_image(node), image).when(text == "", F.lit(None)).when(node["type"] == "callout", quoted).otherwise(text)
    return F.concat(shown, F.lit("\n\n"))


def to_markdown(title: Column, body: Column) -> Column:
    """A document of sections (title, children) as Markdown; blocks without text are left out."""
    section = lambda s: F.concat(F.lit("## "), _or(s["title"], "Section"), F.lit("\n\n"), F.array_join(F.transform(s["children"], _markdown_block), ""))
    sections = F.array_join(F.transform(body, section), "")
    whole = F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce(sections, F.lit("")))
    return F.concat(F.rtrim(whole, F.lit(" \t\n\x0b\x0c\r")), F.lit("\n"))


def escaped(text: Column) -> Column:
    """A text with the five signs that mean something in HTML spelled out."""
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def _html_block(node: Column) -> Column:
    text = F.replace(escaped(node_text(node)), F.lit("\n"), F.lit("<br>\n"))
    language = escaped(_language(node))
    code = F.concat(F.lit('<pre><span class="code-lang-label">'), language, F.lit('</span><code class="language-'), language, F.lit('">'), escaped(node["content"]), F.lit("</code></pre>"))
    caption = F.concat(F.lit("\n<figcaption>"), escaped(_trimmed(node["caption"])), F.lit("</figcaption>"))
    figure = F.concat(F.lit('<figure><img src="'), node["src"], F.lit('" alt="'), escaped(_or(node["alt"], "Image")), F.lit('" style="max-width:100%"/>'), F.when(_trimmed(node["caption"]) != "", caption).otherwise(""), F.lit("\n</figure>"))
    # Only pictures that are part of the page or of its site are shown.
    near = F.startswith(node["src"], F.lit("data:")) | F.startswith(node["src"], F.lit("/"))
    paragraph = F.concat(F.when(node["type"] == "callout", "<blockquote><p>").otherwise("<p>"), text, F.when(node["type"] == "callout", "</p></blockquote>").otherwise("</p>"))
    return F.when(node["type"].isin(CODE), code).when(_is_image(node), F.when(near, figure)).when(node_text(node) == "", F.lit(None)).otherwise(paragraph)


def to_html(title: Column, body: Column, style: str = "") -> Column:
    """A document of sections as a page of its own; ``style`` goes into its head."""
    section = lambda s: F.array_prepend(F.array_compact(F.transform(s["children"], _html_block)), F.concat(F.lit("<h2>"), escaped(_or(s["title"], "Section")), F.lit("</h2>")))
    head = [F.lit("<!DOCTYPE html>"), F.lit('<html lang="en">'), F.lit("<head>"), F.lit('<meta charset="utf-8">'), F.concat(F.lit("<title>"), escaped(title), F.lit("</title>"))]
    head += [F.lit(f"<style>{style}</style>")] if style else []
    head += [F.lit("</head>"), F.lit("<body>"), F.concat(F.lit("<h1>"), escaped(title), F.lit("</h1>"))]
    return F.array_join(F.concat(F.array(*head), F.flatten(F.transform(body, section)), F.array(F.lit("</body>"), F.lit("</html>"), F.lit(""))), "\n")


def answer_file(item: dict[str, Column], form: str, name: str) -> Column:
    """An answer kept from earlier as ``markdown``, ``prompty`` or ``plain`` text: task, answer, models, intent, workflow, tokens and cost."""
    task, answer, models, intent, workflow, when = (F.coalesce(item[k], F.lit("")) for k in ("task", "answer", "models", "intent", "workflow", "timestamp"))
    if form == "plain":
        return F.concat(task, F.lit("\n\n"), answer, F.lit("\n"))
    if form == "prompty":
        head = F.concat(F.lit(f"---\nname: {name} previous work\nauthors:\n  - {name}\nmodel:\n  api: chat\nmetadata:\n  intent: "), intent, F.lit("\n  workflow: "), workflow)
        return F.concat(head, F.lit("\n---\n\n"), task, F.lit("\n\n"), answer, F.lit("\n"))
    if form != "markdown":
        raise ValueError(form)
    cost = F.coalesce(F.format_string("%.2f", item["cost"]), F.lit("n/a"))
    tokens = [F.coalesce(item[k], F.lit(0)).cast("string") for k in ("input", "output", "total")]
    lines = [
        F.concat(F.lit("- Models: "), models), F.concat(F.lit("- Intent: "), intent), F.concat(F.lit("- Workflow: "), workflow),
        F.concat(F.lit("- Tokens: "), tokens[0], F.lit(" in + "), tokens[1], F.lit(" out = "), tokens[2]),
        F.concat(F.lit("- Cost est. USD: "), F.when(item["cost"].isNull(), "n/a").otherwise(cost)), F.concat(F.lit("- When: "), when),
    ]
    return F.concat(F.lit("# "), task, F.lit("\n\n"), _or(answer, "_Answer was not stored._"), F.lit("\n\n"), F.array_join(F.array(*lines), "\n"), F.lit("\n"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes ``files`` (name, text) with a folder for each name, whose one file holds the text and ends with a line feed; repeated attempts replace it."""
    # The writer ends every row with a line feed itself.
    rows = files.select(F.regexp_replace("text", r"\n\z", "").alias("text"), "name")
    rows.repartition("name").write.mode("overwrite").partitionBy("name").text(folder)


def order_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of two sections whose blocks are their lines, of all sorts."""
    kinds = ["paragraph", "callout", "table", "image", "code_block", "image", "paragraph"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_partkey") % 7 + 1).cast("int"))
    odd = F.col("l_suppkey") % 2 == 0
    block = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", kind.alias("type"), F.when(odd, F.concat(F.lit("T<"), "l_partkey")).alias("title"),
        F.when(F.col("l_partkey") % 11 > 0, F.concat(F.lit("a & b\n"), F.col("l_quantity").cast("int"))).alias("content"), F.when(odd, " cap ").alias("caption"),
        F.when(odd, "alt").alias("alt"), F.when(F.col("l_partkey") % 7 == 3, F.when(odd, "/x.png").otherwise("http://x/y.png")).alias("src"), F.when(odd, "sql").alias("language"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(block)).alias("all"))
    part = lambda title, keep: F.struct(title.alias("title"), F.filter("all", keep).alias("children"))
    body = F.array(part(F.col("o_orderpriority"), lambda b: b["l_linenumber"] <= 3), part(F.lit(""), lambda b: b["l_linenumber"] > 3))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", F.concat(F.lit("Order <"), "o_orderkey", F.lit(">")).alias("title"), body.alias("body"))


_BLOCKS = """
WITH b AS (SELECT l_orderkey AS o, l_linenumber > 3 AS second, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i,
    (['paragraph', 'callout', 'table', 'image', 'code', 'image', 'paragraph'])[l_partkey % 7 + 1] AS kind, l_suppkey % 2 = 0 AS odd, l_partkey % 7 = 3 AS pictured,
    CASE WHEN l_suppkey % 2 = 0 THEN 'T<' || l_partkey ELSE '' END AS title, CASE WHEN l_partkey % 11 > 0 THEN 'a & b' || chr(10) || l_quantity::INT ELSE '' END AS content FROM lineitem),
t AS (SELECT *, CASE kind WHEN 'callout' THEN title || CASE WHEN title <> '' AND content <> '' THEN chr(10) ELSE '' END || content
    WHEN 'table' THEN CASE WHEN odd THEN 'cap' WHEN content <> '' THEN content ELSE 'Table' END WHEN 'image' THEN CASE WHEN odd THEN 'cap' ELSE 'Image' END ELSE content END AS text FROM b),
"""


@query(_BLOCKS + """
m AS (SELECT o, second, i, CASE WHEN kind = 'code' THEN '```' || CASE WHEN odd THEN 'sql' ELSE 'text' END || chr(10) || content || CASE WHEN content <> '' THEN chr(10) ELSE '' END || '```'
    WHEN pictured THEN CASE WHEN odd THEN '![alt](/x.png)' || chr(10) || '*cap*' ELSE '![Image](http://x/y.png)' END
    WHEN text = '' THEN NULL WHEN kind = 'callout' THEN '> ' || replace(text, chr(10), chr(10) || '> ') ELSE text END || chr(10) || chr(10) AS block FROM t),
s AS (SELECT o, coalesce(string_agg(block, '' ORDER BY i) FILTER (NOT second), '') AS one, coalesce(string_agg(block, '' ORDER BY i) FILTER (second), '') AS two FROM m GROUP BY 1)
SELECT o_orderkey, sha256(rtrim('# Order <' || o_orderkey || '>' || chr(10) || chr(10) || '## ' || o_orderpriority || chr(10) || chr(10) || one || '## Section' || chr(10) || chr(10) || two, ' ' || chr(10)) || chr(10)) AS markdown
FROM orders JOIN s ON o = o_orderkey
""")
def k8_document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of orders' documents as Markdown."""
    return order_sections(spark, sf_dir).select("o_orderkey", F.sha2(to_markdown(F.col("title"), F.col("body")), 256).alias("markdown"))


@query(_BLOCKS + """
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '<br>' || chr(10)) AS safe, CASE WHEN odd THEN 'sql' ELSE 'text' END AS lang FROM t),
m AS (SELECT o, second, i, CASE WHEN kind = 'code' THEN '<pre><span class="code-lang-label">' || lang || '</span><code class="language-' || lang || '">' || replace(content, '&', '&amp;') || '</code></pre>'
    WHEN pictured THEN CASE WHEN odd THEN '<figure><img src="/x.png" alt="alt" style="max-width:100%"/>' || chr(10) || '<figcaption>cap</figcaption>' || chr(10) || '</figure>' END
    WHEN text = '' THEN NULL WHEN kind = 'callout' THEN '<blockquote><p>' || safe || '</p></blockquote>' ELSE '<p>' || safe || '</p>' END AS block FROM e),
s AS (SELECT o, coalesce(string_agg(block || chr(10), '' ORDER BY i) FILTER (NOT second), '') AS one, coalesce(string_agg(block || chr(10), '' ORDER BY i) FILTER (second), '') AS two FROM m GROUP BY 1)
SELECT o_orderkey, sha256(array_to_string(['<!DOCTYPE html>', '<html lang="en">', '<head>', '<meta charset="utf-8">', '<title>Order &lt;' || o_orderkey || '&gt;</title>', '</head>', '<body>',
  '<h1>Order &lt;' || o_orderkey || '&gt;</h1>', '<h2>' || o_orderpriority || '</h2>'], chr(10)) || chr(10) || one || '<h2>Section</h2>' || chr(10) || two || '</body>' || chr(10) || '</html>' || chr(10)) AS html FROM orders JOIN s ON o = o_orderkey
""")
def k8_document_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of orders' documents as pages."""
    return order_sections(spark, sf_dir).select("o_orderkey", F.sha2(to_html(F.col("title"), F.col("body")), 256).alias("html"))


@query("""
WITH a AS (SELECT conv_id, turn, 'Turn ' || turn AS task, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS answer, role FROM conversations)
SELECT conv_id, turn, sha256('# ' || task || chr(10) || chr(10) || CASE WHEN answer = '' THEN '_Answer was not stored._' ELSE answer END || chr(10) || chr(10) || '- Models: ' || role || chr(10) || '- Intent: ' || chr(10)
  || '- Workflow: w' || chr(10) || '- Tokens: ' || length(answer) || ' in + 0 out = ' || length(answer) || chr(10) || '- Cost est. USD: ' || CASE WHEN turn % 2 = 0 THEN 'n/a' ELSE format('{:.2f}', turn / 4.0::DOUBLE) END || chr(10) || '- When: ' || chr(10)) AS markdown,
  sha256('---' || chr(10) || 'name: N previous work' || chr(10) || 'authors:' || chr(10) || '  - N' || chr(10) || 'model:' || chr(10) || '  api: chat' || chr(10) || 'metadata:' || chr(10) || '  intent: ' || chr(10) || '  workflow: w' || chr(10)
  || '---' || chr(10) || chr(10) || task || chr(10) || chr(10) || answer || chr(10)) AS prompty, sha256(task || chr(10) || chr(10) || answer || chr(10)) AS plain FROM a
""")
def k8_answer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of turns as answers kept, in three forms."""
    answer = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    size = F.length(answer)
    item = {"task": F.concat(F.lit("Turn "), "turn"), "answer": answer, "models": F.col("role"), "intent": F.lit(None).cast("string"), "workflow": F.lit("w"), "timestamp": F.lit(None).cast("string"), "input": size, "output": F.lit(None).cast("int"), "total": size, "cost": F.when(F.col("turn") % 2 == 1, F.col("turn") / 4)}
    forms = ("markdown", "prompty", "plain")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.sha2(answer_file(item, form, "N"), 256).alias(form) for form in forms])
