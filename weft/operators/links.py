"""Links in page sources, and the ledger of links against mentions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as fx
from ..functions import text as tx
from ..functions.fixed import NAMESPACES, PLACES

_OPEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|<(/?)(ref|table|td|th|tr|i|gallery)\b[^>]*?(/?)>|\{\||\|\}|''+|\n==([^=\n]+)==[ \t]*(?=\n)", re.IGNORECASE)


def strip_code(text: str) -> str:
    """What a reader sees of wikitext: no templates, galleries, tags or quotes of italics; of a link its words, to any depth. What is not closed
    stays as it is."""
    stack, at = [("", [])], 0

    def close(kind: str) -> str | None:
        """The text since the innermost construct of a kind was opened; None if none is open."""
        if all(k != kind for k, _ in stack):
            return None
        while stack[-1][0] != kind:
            opened, parts = stack.pop()
            stack[-1][1].append(("" if opened == "gallery" else opened) + "".join(parts))
        return "".join(stack.pop()[1])

    for m in _OPEN.finditer(text):
        stack[-1][1].append(text[at : m.start()])
        at, t = m.end(), m.group()
        if t in ("{{", "[["):
            stack.append((t, []))
        elif t == "}}":
            if close("{{") is None:
                stack[-1][1].append(t)
        elif t == "]]":
            inner = close("[[")
            stack[-1][1].append(t if inner is None else inner.partition("|")[2] if "|" in inner else inner)
        elif (m.group(2) or "").lower() == "gallery" and not m.group(3):
            if m.group(1):
                close("gallery")
            else:
                stack.append(("gallery", []))
        elif m.group(4):
            stack[-1][1].append("\n" + m.group(4).strip())
    stack[-1][1].append(text[at:])
    while len(stack) > 1:
        opened, parts = stack.pop()
        stack[-1][1].append(("" if opened == "gallery" else opened) + "".join(parts))
    return "".join(stack[0][1])


def parse_wikitext(text: str) -> list[tuple[str, str, str, str, str]]:
    """(target, shown, place, section, line) of each [[link]] in the order in which they begin, links in the words of others too: its place by
    the outermost construct around it that decides one; its words and its line as a reader sees them."""
    out, stack, section = [], [], "Lead"
    for m in _OPEN.finditer(text):
        t = m.group()
        if t == "{{":
            name = re.match(r"\s*([^|}\n]*)", text[m.end() :])[1].strip().lower()
            stack.append(("{{", "infobox" if name.startswith("infobox") else "template", m.end()))
        elif t == "[[":
            stack.append(("[[", "image caption", m.end()))
        elif t == "{|":
            stack.append(("{|", "table", m.end()))
        elif t in ("}}", "|}"):
            want = "{{" if t == "}}" else "{|"
            if any(s[0] == want for s in stack):
                while stack.pop()[0] != want:
                    pass
        elif t == "]]":
            if any(s[0] == "[[" for s in stack):
                while (top := stack.pop())[0] != "[[":
                    pass
                inner = text[top[2] : m.start()]
                target, _, shown = inner.partition("|")
                low = text.rfind("\n", 0, top[2]) + 1
                high = text.find("\n", m.end())
                line = text[low : high if high >= 0 else len(text)]
                place = stack[0][1] if stack else "list" if line.lstrip().startswith(("*", "#", ";", ":")) else "prose"
                if target.split(":")[0].strip() not in NAMESPACES:
                    out.append((top[2], target.strip(), (strip_code(shown) if shown else target).strip(), place, section, re.sub(r"\s+", " ", strip_code(line))))
        elif m.group(4):
            section, stack = m.group(4).strip(), []
        elif t.startswith("''"):
            if len(t) == 2:
                if any(s[0] == "''" for s in stack):
                    while stack.pop()[0] != "''":
                        pass
                else:
                    stack.append(("''", "italic title", m.end()))
        elif m.group(2) and not m.group(3):
            tag = m.group(2).lower()
            if m.group(1):
                if any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
            else:
                stack.append((tag, {"ref": "reference", "i": "italic title", "gallery": "gallery"}.get(tag, "table"), m.end()))
    return [row for _, *row in sorted(out, key=lambda row: row[0])]


def wikilinks(pages: DataFrame) -> DataFrame:
    """page, pos, target, shown, place, section, line of pages (page, wikitext)."""
    names = ["page", "pos", "target", "shown", "place", "section", "line"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, i, *row) for p, t in zip(pdf["page"], pdf["wikitext"]) for i, row in enumerate(parse_wikitext(t or ""))], columns=names)

    return pages.select("page", "wikitext").mapInPandas(run, ", ".join(f"{n} {'long' if n in ('page', 'pos') else 'string'}" for n in names))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, target, shown, place of the <a href> links of pages (page_id, html): list inside <li>, else prose."""
    hits = F.regexp_extract_all("html", F.lit(r'(<li>)?<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(hits).alias("pos", "hit"))
    part = lambda k: F.regexp_extract("hit", r'(<li>)?<a href="([^"]*)">([^<]*)</a>', k)
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), part(2).alias("target"), part(3).alias("shown"), F.when(part(1) == "", "prose").otherwise("list").alias("place"))


def titles(redirects: DataFrame) -> DataFrame:
    """title, node: the first node (by ord) that has a title. redirects: node, ord, title."""
    t = F.trim(F.translate(F.substring_index("title", "#", 1), "_", " "))
    norm = F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))
    return redirects.select(norm.alias("title"), "node", "ord").groupBy("title").agg(F.expr("min_by(node, struct(ord, node))").alias("node"))


def strength():
    """Rank of a link's place; an unknown place comes after all."""
    return F.coalesce(*[F.when(F.col("place") == p, F.lit(i)) for i, p in enumerate(PLACES)], F.lit(len(PLACES)))


def best_link(links: DataFrame, by: list[str]) -> DataFrame:
    """The link of each group with the strongest place, then the most frequent target, then the smallest target."""
    n = F.count("*").over(Window.partitionBy(*by, "target"))
    order = Window.partitionBy(*by).orderBy("rank", F.desc("n"), "target", "shown")
    return links.withColumn("rank", strength()).withColumn("n", n).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "rank", "n")


def redirect_titles(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """node, titles: the titles that lead to each node: its own, and, where it alone has its present one, that and all that redirect to it.
    pages: node (a title with underscores), title_now; redirects: dest, title."""
    alone = pages.withColumn("n", F.count("*").over(Window.partitionBy("title_now"))).filter("n = 1 and title_now is not null").select("node", "title_now")
    every = pages.select("node", F.translate("node", "_", " ").alias("title")).union(alone)
    every = every.union(alone.join(redirects, F.col("title_now") == F.col("dest")).select("node", "title"))
    return every.groupBy("node").agg(F.sort_array(F.collect_set("title")).alias("titles"))


def ledger(links: DataFrame, mentions: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """a, b, linked, named, back, why of every pair that is linked or named. links: a, b; mentions: a, b, named; reasons: a, b, reason."""
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    rows = links.withColumn("linked", F.lit(True)).join(mentions, ["a", "b"], "full").join(back, ["a", "b"], "left").na.fill(False, ["linked", "back"]).na.fill(0, ["named"])
    if reasons is not None:
        rows = rows.join(reasons, ["a", "b"], "left")
    why = F.when(F.col("linked") & (F.col("named") > 0), "both").otherwise(F.coalesce(F.col("reason") if reasons is not None else F.lit(None), F.when(F.col("linked"), "linked from other words").otherwise("never linked on this page")))
    return rows.select("a", "b", "linked", "named", "back", why.alias("why"))


_SOURCE = "if(max(rank) is null, null, min_by(struct(place, shown, target, to, line), {}))"


def why_unnamed(pairs: DataFrame, links: DataFrame, resolved: DataFrame, own: DataFrame, cands: DataFrame) -> DataFrame:
    """a, b, reason, src of linked pairs (a, b) that a's text doesn't name, by what its source shows. links: page, pos, to, target, shown,
    place, section, line; resolved: name, pick; own: node, name; cands: name, node. The first reason that holds decides; src is the link
    with the strongest place, the first of such."""
    rows = pairs.select("a", "b").join(links.withColumnsRenamed({"page": "a"}).withColumn("b", F.col("to")), ["a", "b"], "left").withColumn("rank", strength())
    read = ~F.coalesce(F.col("section").isin(fx.SKIPPED), F.lit(False))
    rows = rows.withColumn("read", F.col("pos").isNotNull() & read)
    picks = resolved.select(F.col("name").alias("shown"), "pick")
    mine = own.select(F.col("node").alias("a"), F.col("name").alias("shown"), F.lit(True).alias("is_own")).distinct()
    theirs = own.select(F.col("node").alias("b"), F.col("name").alias("shown"), F.lit(True).alias("is_theirs")).distinct()
    claimed = cands.select(F.col("node").alias("b"), F.col("name").alias("shown"), F.lit(True).alias("claimed")).distinct()
    rows = rows.join(picks, "shown", "left").join(mine, ["a", "shown"], "left").join(theirs, ["b", "shown"], "left").join(claimed, ["b", "shown"], "left")
    said = F.col("read") & F.col("place").isin("prose", "list")
    any_of = lambda flag: F.coalesce(F.bool_or(said & F.coalesce(flag, F.lit(False))), F.lit(False))
    per = rows.groupBy("a", "b").agg(
        F.count("pos").alias("n"), F.count_if("read").alias("n_read"), F.min(F.when(F.col("read"), F.col("rank"))).alias("best"),
        any_of(F.col("pick") != F.col("b")).alias("elsewhere"), any_of(F.col("is_own")).alias("own"), any_of(F.col("claimed") & F.col("pick").isNull()).alias("open"),
        any_of((F.col("pick") == F.col("b")) | F.col("is_theirs")).alias("missed"),
        F.expr(f"coalesce({_SOURCE.format('if(read, struct(rank, pos), null)')}, {_SOURCE.format('struct(pos)')})").alias("src"),
    )
    place = F.element_at(F.array(*map(F.lit, [*PLACES, "gallery"])), F.col("best") + 1)
    reason = F.when(F.col("n") == 0, fx.MISSING).when(F.col("n_read") == 0, "only in In other media, which we leave out").when(place == "infobox", "only in the infobox")
    reason = reason.when(place.isin("italic title", "reference"), "only in a comic title or a reference").when(place.isin("table", "image caption", "template"), "only in a table or caption")
    reason = reason.when(F.col("elsewhere"), "a shared codename we give to another page").when(F.col("own"), "the page's own codename, which we read as the page itself")
    reason = reason.when(F.col("open"), "a shared codename we leave unresolved").when(F.col("missed"), "named, but our matcher missed it").otherwise("linked from other words")
    return per.select("a", "b", reason.alias("reason"), "src")


def why_unlinked(pairs: DataFrame, links: DataFrame, shown: DataFrame) -> DataFrame:
    """a, b, reason, src of named pairs (a, b) that a doesn't link, by where its source sends the words. shown: a, b, shown; links as in
    why_unnamed. src is the link with the strongest place, of such to the most frequent target, the first of such."""
    rows = pairs.select("a", "b").join(shown, ["a", "b"], "left").join(links.withColumnRenamed("page", "a").filter(~F.coalesce(F.col("section").isin(fx.SKIPPED), F.lit(False))), ["a", "shown"], "left")
    rows = rows.withColumn("rank", F.when(F.col("pos").isNotNull(), strength())).withColumn("n", F.count("pos").over(Window.partitionBy("a", "b", "target")))
    per = rows.groupBy("a", "b").agg(F.expr(_SOURCE.format("if(pos is null, null, struct(rank, -n, pos))")).alias("src"))
    reason = F.when(F.col("src").isNull(), "never linked on this page").when(F.col("src.to").isNotNull(), "the name is linked to another of our pages").otherwise("the name is linked to a page outside the 303")
    return per.select("a", "b", reason.alias("reason"), "src")


def full_ledger(links: DataFrame, mentions: DataFrame, unnamed: DataFrame, unlinked: DataFrame) -> DataFrame:
    """a, b, linked, named, story, back, why, code, family, src of every pair that is linked or named. mentions: a, b, named, story."""
    reasons = unnamed.select("a", "b", "reason").union(unlinked.select("a", "b", "reason"))
    src = unnamed.select("a", "b", "src").union(unlinked.select("a", "b", "src"))
    rows = ledger(links, mentions.select("a", "b", "named"), reasons).join(mentions.select("a", "b", "story"), ["a", "b"], "left").na.fill(0, ["story"])
    return coded(rows.join(src, ["a", "b"], "left"))


def coded(rows: DataFrame) -> DataFrame:
    """rows (why and others) with each reason's code and family."""
    table = rows.sparkSession.createDataFrame(fx.REASONS, "why string, code string, family string")
    return rows.join(F.broadcast(table), "why", "left")  # a row for each reason


def exported(full: DataFrame, evidence: DataFrame) -> DataFrame:
    """a, b, pair: each row of full_ledger as one struct, with its sentences (a, b, rank, sec, text, marks) and its link's line around the
    words shown."""
    ev = evidence.groupBy("a", "b").agg(F.expr("transform(array_sort(collect_list(struct(rank, text, marks, sec))), e -> struct(e.text as t, e.marks as h, e.sec as sec))").alias("ev"))
    line, shown = F.col("src.line"), F.col("src.shown")
    src = F.when(F.col("src").isNotNull(), F.struct(F.col("src.place").alias("p"), shown.alias("sh"), F.col("src.target").alias("t"), F.col("src.to").alias("to"), tx.clipped(line, shown).alias("ln")))
    pair = F.struct(F.col("linked").cast("int").alias("l"), F.col("named").alias("n"), F.col("code").alias("w"), F.col("story").alias("s"), F.col("back").cast("int").alias("bk"), F.coalesce("ev", F.expr("array()")).alias("ev"), src.alias("src"))
    return full.join(ev, ["a", "b"], "left").select("a", "b", pair.alias("pair"))
