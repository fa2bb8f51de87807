"""Queries on the sources: tables written in a source's format below the shared folder, and read by its reader."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..sources import readers
from ..storage import shared_dir
from . import base as b
from .registry import query

_NODES = "select cast(p_partkey as varchar) node_id, p_name as \"name\", {} description, p_type url, cast(p_size as varchar) wikidata_id from part"


def _roster(spark, d, description):
    return b.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_name").alias("name"), description.alias("description"), F.col("p_type").alias("url"), F.col("p_size").cast("string").alias("wikidata_id"))


@query("src_nodes_tsv", _NODES.format("'say \"' || p_brand || '\"'"))
def src_nodes_tsv(spark, d):
    """Quoted fields, with tabs and quotes of their own."""
    path = shared_dir(spark)
    _roster(spark, d, F.concat(F.lit('say "'), "p_brand", F.lit('"'))).write.option("sep", "\t").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return readers.nodes_tsv(spark, path, escape='"')


@query("src_nodes_tsv_raw", _NODES.format("'\"' || p_brand"))
def src_nodes_tsv_raw(spark, d):
    """A quote is a character like any other."""
    path = shared_dir(spark)
    _roster(spark, d, F.concat(F.lit('"'), "p_brand")).write.option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)
    return readers.nodes_tsv(spark, path, quoted=False)


@query("src_wedges_tsv", b.sql(b.WEIGHTED, "select cast(src as varchar) src, cast(dst as varchar) dst, weight from w"))
def src_wedges_tsv(spark, d):
    path = shared_dir(spark)
    b.weighted(spark, d).select("src", "dst", "weight").write.option("sep", "\t").option("header", True).csv(path)
    return readers.weighted_tsv(spark, path)


@query("src_zip_text", "select n_name page, r_name || ': é' as text from nation join region on r_regionkey = n_regionkey")
def src_zip_text(spark, d):
    """An archive for each region, a file for each nation."""
    rows = b.read(spark, d, "nation").join(F.broadcast(b.read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # region: 5 rows

    def pack(key, pdf):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("pages/README.txt", "not a page")
            for name in sorted(pdf["n_name"]):
                z.writestr(f"pages/{name.replace(' ', '%20')}.txt", f"{key[0]}: é")
        return pd.DataFrame({"content": [raw.getvalue()]})

    return readers.unzipped(rows.groupBy("r_name").applyInPandas(pack, "content binary"))


_ALIASES = "select cast(s_suppkey as varchar) node, nullif(s_name, '') as \"label\", unnest([s_name || ' Ltd', 'No. ' || s_nationkey]) alias from supplier where s_nationkey > 3 union all select cast(s_suppkey as varchar), s_name, null from supplier where s_nationkey <= 3"


def _alias_files(spark, d):
    names = F.expr("if(s_nationkey > 3, array(concat(s_name, ' Ltd'), concat('No. ', s_nationkey)), array())")
    one = b.read(spark, d, "supplier").select((F.col("s_suppkey") % 7).alias("file"), F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(F.col("s_name").alias("label"), names.alias("aliases")).alias("value")).alias("entry"))
    return one.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list("entry"))).alias("value")).select("value")


@query("src_json", _ALIASES)
def src_json(spark, d):
    """Objects with dynamic keys, one in each file."""
    path = shared_dir(spark)
    _alias_files(spark, d).write.option("maxRecordsPerFile", 1).text(path)
    return readers.aliases(spark, path)


@query("src_json_gz", _ALIASES)
def src_json_gz(spark, d):
    path = shared_dir(spark)
    _alias_files(spark, d).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return readers.aliases(spark, path)
