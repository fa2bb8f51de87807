"""TF-IDF in long form (doc, term, w), and the cosine of documents split exactly by the classes of their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

NAME, PAPER, STORY = 0, 1, 2
NAME_CAP = 0.5
PAPER_SHARE = 0.7
MIN_DF = 2
MAX_DF = 0.5
TOP_TERMS = 14
#: documents whose pairs are all compared, at most; beyond, cosines_to compares a stated set of documents with all
MOST_PAIRED = 20_000
#: parts that a term's documents are dealt over in cosines_to
PARTS = 16


def words(docs: DataFrame) -> DataFrame:
    """doc, word (with its case) of docs (doc, text); other columns are passed on."""
    return docs.select("*", F.explode(tx.letters(F.col("text"))).alias("word")).drop("text")


def word_stats(tokens: DataFrame, paper: str = "false") -> DataFrame:
    """term, seen, cap, in_paper: uses, capitalised ones, and those where the expression paper holds. tokens: word and what paper reads."""
    return tokens.groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("seen"), F.sum(F.expr("if(word rlike '^[A-Z]', 1L, 0L)")).alias("cap"), F.sum(F.expr(f"if({paper}, 1L, 0L)")).alias("in_paper"))


def classes(stats: DataFrame, name_cap: float = NAME_CAP, paper_share: float = PAPER_SHARE, titles: DataFrame | None = None) -> DataFrame:
    """term, cls: a name if mostly capitalised (or in titles), else paperwork if mostly used there, else story."""
    cls = F.when(F.col("cap") > name_cap * F.col("seen"), NAME).when(F.col("in_paper") / F.col("seen") > paper_share, PAPER).otherwise(STORY)
    if titles is not None:
        stats = stats.join(titles.select("term", F.lit(True).alias("titled")).distinct(), "term", "left")
        cls = F.when(F.col("titled"), NAME).otherwise(cls)
    return stats.select("term", cls.alias("cls"))


def weights(tokens: DataFrame, stop: DataFrame | None = None, min_df: int = MIN_DF, max_df: float = MAX_DF, sublinear: bool = False) -> DataFrame:
    """doc, term, w: tf * (ln((1 + n) / (1 + df)) + 1), rows of unit length. tokens: doc, word; words of one letter and stop words
    drop out, and terms on under min_df documents or over max_df of them."""
    n = tokens.agg(F.count_distinct("doc").alias("n"))
    terms = tokens.select("doc", F.lower("word").alias("term")).filter("length(term) > 1")
    if stop is not None:
        terms = terms.join(F.broadcast(stop), "term", "left_anti")  # a list of words, a few hundred
    tf = terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(n).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    value = (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = tf.join(df, "term").select("doc", "term", value.alias("v"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("v") / F.col("norm")).alias("w"))


def renormalised(w: DataFrame, cls: DataFrame, keep: int) -> DataFrame:
    """w of one class, rows of unit length again."""
    own = w.join(cls.filter(F.col("cls") == keep).select("term"), "term")
    norm = own.groupBy("doc").agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-12)).alias("norm"))
    return own.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def cosines(w: DataFrame, cls: DataFrame | None = None) -> DataFrame:
    """i < j, cos (and name_part, paper_part, story_part, whose sum it is) of pairs with a common term. All pairs are the result; a
    corpus of over MOST_PAIRED documents is refused."""
    n = w.select("doc").distinct().count()
    if n > MOST_PAIRED:
        raise ValueError(f"{n} documents; all pairs are compared for {MOST_PAIRED} at most")
    a = w.select(F.col("doc").alias("i"), "term", F.col("w").alias("wi"))
    c = w.select(F.col("doc").alias("j"), "term", F.col("w").alias("wj"))
    rows = a.join(c, "term").filter("i < j").withColumn("p", F.col("wi") * F.col("wj"))
    return _summed(rows, cls)


def cosines_to(w: DataFrame, asked: DataFrame, cls: DataFrame | None = None) -> DataFrame:
    """i of asked (doc), j another document of w, and what cosines gives of them, of all such pairs with a common term, whatever their
    number is. A frequent term's documents are dealt over PARTS tasks."""
    part = F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int")
    a = w.join(asked.select("doc").distinct(), "doc", "left_semi").select(F.col("doc").alias("i"), "term", F.col("w").alias("wi"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    c = w.select(F.col("doc").alias("j"), "term", F.col("w").alias("wj"), part.alias("part"))
    return _summed(a.join(c, ["term", "part"]).filter("i <> j").withColumn("p", F.col("wi") * F.col("wj")).select("i", "j", "term", "p"), cls)


def _summed(rows: DataFrame, cls: DataFrame | None) -> DataFrame:
    if cls is None:
        return rows.groupBy("i", "j").agg(F.sum("p").alias("cos"))
    part = lambda k, name: F.sum(F.when(F.col("cls") == k, F.col("p")).otherwise(0.0)).alias(name)
    return rows.join(cls, "term").groupBy("i", "j").agg(F.sum("p").alias("cos"), part(NAME, "name_part"), part(PAPER, "paper_part"), part(STORY, "story_part"))


def both_ways(pairs: DataFrame) -> DataFrame:
    other = {"i": "j", "j": "i"}
    return pairs.unionByName(pairs.select(*[F.col(other.get(c, c)).alias(c) for c in pairs.columns]))


def nearest(pairs: DataFrame, k: int = 1, score: str = "cos") -> DataFrame:
    """The k best partners of each document, ties to the smaller one (of scores rounded to 9 places)."""
    return best(both_ways(pairs), k, score)


def best(rows: DataFrame, k: int = 1, score: str = "cos") -> DataFrame:
    """As nearest, of rows that have i's partners j already."""
    order = Window.partitionBy("i").orderBy(F.desc(F.round(score, 9)), "j")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def term_products(w: DataFrame, pairs: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """i, j, term, p, rank: the k largest products of the pairs' terms."""
    rows = pairs.select("i", "j").join(w.select(F.col("doc").alias("i"), "term", F.col("w").alias("wi")), "i").join(w.select(F.col("doc").alias("j"), "term", F.col("w").alias("wj")), ["j", "term"])
    order = Window.partitionBy("i", "j").orderBy(F.desc(F.round(F.col("p"), 9)), "term")
    return rows.withColumn("p", F.col("wi") * F.col("wj")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("i", "j", "term", "p", "rank")


def effective_terms(products: DataFrame, cls: DataFrame) -> DataFrame:
    """i, j, neff: 1 / sum of squared shares over the name terms among the kept products; 0 without any."""
    rows = products.join(cls, "term").groupBy("i", "j").agg(F.sum(F.expr("if(cls = 0, p, 0d)")).alias("s"), F.sum(F.expr("if(cls = 0, p * p, 0d)")).alias("q"))
    return rows.select("i", "j", F.expr("if(s > 0, s * s / q, 0d)").alias("neff"))


def term_mass(w: DataFrame) -> DataFrame:
    """term, mass: the sum over all pairs of the term's products, without making the pairs."""
    return w.groupBy("term").agg(((F.pow(F.sum("w"), 2) - F.sum(F.col("w") * F.col("w"))) / 2).alias("mass"))


def auc(rows: DataFrame, score: str, label: str, zeros: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve, by average ranks of the distinct scores. zeros: s, n, pos of rows that are not there."""
    c = rows.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.expr(f"if({label}, 1L, 0L)")).alias("pos"))
    if zeros is not None:
        c = c.unionByName(zeros).groupBy("s").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    up = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = c.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    t = ranked.agg(F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return t.select(F.expr("if(p > 0 and q > 0, (r - p * (p + 1) / 2) / (p * q), null)").alias("auc"))
