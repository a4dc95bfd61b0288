"""The entity dictionary as DataFrames.

The dictionary is configuration: a few hundred entities with their names. It arrives as rows
(or as the JSON document read by ``from_json``) and leaves as small DataFrames that Spark
broadcasts by itself while they are below the broadcast threshold, and shuffles beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import text as T
from ..functions import values as V
from ..session import small_table

DOCUMENT_SCHEMA = (
    "stocks array<struct<ticker:string,name_cn:string,sector:string,asset_class:string,"
    "aliases:array<string>,ambiguous:array<string>,supersedes:array<string>,quote_symbol:string>>, "
    "context_words array<string>, collision_tickers array<string>, traps array<string>, "
    "topic_tags array<struct<tag:string,aliases:array<string>>>"
)
NO_STRINGS = "array<string>"


@dataclass
class Dictionary:
    stocks: DataFrame          # schemas.STOCKS
    context_words: DataFrame   # word
    collisions: DataFrame      # ticker
    traps: DataFrame           # ord, phrase
    topics: DataFrame          # ord, tag, aliases

    @classmethod
    def from_rows(cls, spark: SparkSession, stocks, context_words=(), collisions=(), traps=(),
                  topics=()) -> Dictionary:
        return cls(
            small_table(spark, stocks, S.STOCKS),
            small_table(spark, [(w,) for w in context_words], "word string"),
            small_table(spark, [(t,) for t in collisions], "ticker string"),
            small_table(spark, enumerate(traps), "ord int, phrase string"),
            small_table(spark, [(i, tag, list(a)) for i, (tag, a) in enumerate(topics)],
                        "ord int, tag string, aliases array<string>"),
        )

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, overlay: str | None = None) -> Dictionary:
        """The dictionary document at ``path``, merged with the one at ``overlay`` if that is there. An overlay that is no
        JSON document reads as an empty one."""
        doc = spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)
        stocks = doc.select(F.inline("stocks")).withColumnRenamed("name_cn", "name")
        topics = doc.select(F.posexplode("topic_tags").alias("ord", "t"))
        base = cls(
            with_array_defaults(stocks),
            doc.select(F.explode("context_words").alias("word")),
            doc.select(F.explode("collision_tickers").alias("ticker")),
            doc.select(F.posexplode("traps").alias("ord", "phrase")),
            topics.select("ord", "t.tag", "t.aliases"),
        )
        if overlay is None:
            return base
        at = spark._jvm.org.apache.hadoop.fs.Path(overlay)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return base.merged(cls.from_json(spark, overlay)) if there else base

    def merged(self, overlay: Dictionary) -> Dictionary:
        """Entities, context words and collisions of both; traps and topics are the base's alone."""
        return replace(self, stocks=merge_overlay(self.stocks, overlay.stocks),
                       context_words=merge_words(self.context_words, overlay.context_words),
                       collisions=merge_words(self.collisions, overlay.collisions))


def with_array_defaults(stocks: DataFrame) -> DataFrame:
    empty = F.array().cast(NO_STRINGS)
    return stocks.withColumns(
        {c: F.coalesce(F.col(c), empty) for c in ("aliases", "ambiguous", "supersedes")}
    )


def merge_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Union of two dictionaries: name, sector and class of the base entry are kept, alias lists
    are joined in order without repeats, unknown tickers are added."""
    b, o = with_array_defaults(base).alias("b"), with_array_defaults(overlay).alias("o")
    known = F.col("b.ticker").isNotNull()

    def keep(name: str) -> Column:
        return F.when(known, F.col(f"b.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    def joined(name: str) -> Column:
        empty = F.array().cast(NO_STRINGS)
        return F.array_distinct(F.concat(
            F.coalesce(F.col(f"b.{name}"), empty), F.coalesce(F.col(f"o.{name}"), empty)
        )).alias(name)

    return b.join(o, F.col("b.ticker") == F.col("o.ticker"), "full_outer").select(
        F.coalesce("b.ticker", "o.ticker").alias("ticker"), keep("name"), keep("sector"),
        keep("asset_class"), joined("aliases"), joined("ambiguous"), keep("supersedes"),
        keep("quote_symbol"),
    )


def merge_words(base: DataFrame, overlay: DataFrame) -> DataFrame:
    return base.unionByName(overlay).distinct()


def add_aliases(overlay: DataFrame, accepted: DataFrame) -> DataFrame:
    """Append accepted (term, ticker) pairs to the overlay as ambiguous names."""
    terms = accepted.groupBy("ticker").agg(F.array_sort(F.collect_set("term")).alias("ambiguous"))
    empty = F.array().cast(NO_STRINGS)
    new = terms.select(
        "ticker", F.lit("").alias("name"), F.lit(None).cast("string").alias("sector"),
        F.lit(None).cast("string").alias("asset_class"), empty.alias("aliases"), "ambiguous",
        empty.alias("supersedes"), F.lit(None).cast("string").alias("quote_symbol"),
    )
    return merge_overlay(overlay, new)


def asset_class(explicit="asset_class", sector="sector") -> Column:
    return F.coalesce(
        F.when(F.col(explicit) != "", F.col(explicit)),
        F.when(F.col(sector) == K.INDEX_SECTOR, F.lit("index")).otherwise(F.lit("stock")),
    )


def classified(stocks: DataFrame) -> DataFrame:
    """Adds class, and the flags the boards use."""
    c = F.col("asset_class")
    return stocks.withColumn("asset_class", asset_class()).withColumns({
        "is_index": c == "index",
        "is_investment": c.isin(*K.INVESTMENT_CLASSES),
        "is_non_stock": (c == "index") | c.isin(*K.INVESTMENT_CLASSES),
    })


def quoteable(stocks: DataFrame) -> DataFrame:
    """Entities with a price, and the symbol to ask for."""
    own = F.when(F.col("quote_symbol") != "", F.col("quote_symbol"))
    return classified(stocks).filter(
        F.col("asset_class").isin("stock", "index") | own.isNotNull()
    ).select("ticker", "asset_class", F.coalesce(own, V.quote_symbol("ticker")).alias("symbol"))


def known_terms(stocks: DataFrame) -> DataFrame:
    names = F.concat(F.array("ticker"), F.coalesce("aliases", F.array().cast(NO_STRINGS)),
                     F.coalesce("ambiguous", F.array().cast(NO_STRINGS)))
    return stocks.select(F.explode(F.transform(names, lambda x: F.lower(x))).alias("term")).distinct()


def tracked_queries(dictionary: Dictionary, tracked: DataFrame) -> DataFrame:
    """Search queries for tracked tickers: (query_key, query, ticker).

    The symbol, the first safe name or else the first ambiguous one, and the custom keywords;
    names without a finance word get one appended. The first ticker in order owns a query.
    """
    words = dictionary.context_words.agg(
        F.collect_list(F.lower("word")).alias("w")
    ).scalar()
    tracked = tracked.withColumn("_words", words)

    def qualified(x: Column) -> Column:
        return F.when(
            F.exists("_words", lambda w: F.contains(F.lower(x), w)), x
        ).otherwise(F.concat(x, F.lit(" " + K.QUERY_QUALIFIER)))

    empty = F.array().cast(NO_STRINGS)
    custom = F.coalesce(F.from_json("custom_keywords", NO_STRINGS), empty)
    own = (
        F.when(F.size("aliases") > 0, F.slice("aliases", 1, 1))
        .when(F.size("ambiguous") > 0, F.transform(F.slice("ambiguous", 1, 1), qualified))
        .otherwise(empty)
    )
    listed = with_array_defaults(
        tracked.join(dictionary.stocks.select("ticker", "aliases", "ambiguous", "supersedes"),
                     "ticker", "left")
    ).select(
        "ticker",
        F.posexplode(F.concat(
            F.array("ticker"), own,
            F.transform(F.filter(custom, lambda k: k != ""), qualified),
        )).alias("pos", "query"),
    )
    first = F.min_by(F.struct("query", "ticker"), F.struct("ticker", "pos"))
    return listed.groupBy(F.lower("query").alias("query_key")).agg(first.alias("f")).select(
        "query_key", "f.query", "f.ticker"
    )


def trap_phrases(dictionary: Dictionary) -> Column:
    """All trap phrases in order, lower case, as one array value."""
    return dictionary.traps.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", F.lower("phrase").alias("p")))), lambda x: x["p"]
    ).alias("t")).scalar()


TERM_COLUMNS = (
    "kind string, term string, ticker string, alias string, ord int, collision boolean, "
    "supersedes array<string>, guard string"
)
MAX_INLINE_TERMS = 50_000


def symbol_guards(symbols: DataFrame) -> DataFrame:
    """(ticker, guard): for symbols that stand inside longer ones, look-arounds that turn down such places.

    At a place the longest symbol is meant: in ``BRK.B`` the symbol ``BRK`` is not. Only symbols with a separator
    can hold another one, so only their bounded stretches are joined with the symbols."""
    edge = "[A-Za-z0-9]"
    pieces = symbols.filter(F.col("ticker").rlike("[^A-Za-z0-9]")).select(
        "ticker", F.array_remove(F.split("ticker", f"(?<={edge})(?!{edge})|(?<!{edge})(?={edge})"), "").alias("p"))
    places = pieces.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select(
        "p", "i", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("i") + 1)).alias("n")).filter("n < size(p)")

    def text(start, length):
        return F.array_join(F.slice("p", start, length), "")

    i, n = F.col("i"), F.col("n")
    inner = places.select(text(i, n).alias("ticker"), text(F.lit(1), i - 1).alias("pre"),
                          text(i + n, F.size("p") - n - i + 1).alias("post"))
    behind = F.when(F.col("pre") == "", F.lit("")).otherwise(F.concat(F.lit(f"(?<=(?<!{edge})\\Q"), "pre", F.lit("\\E)")))
    guard = F.concat(F.lit("(?!"), behind, F.lit("\\Q"), "ticker", "post", F.lit(f"\\E(?!{edge}))"))
    return inner.join(symbols, "ticker", "left_semi").select("ticker", guard.alias("g")).groupBy("ticker").agg(
        F.array_join(F.array_sort(F.collect_set("g")), "").alias("guard"))


def match_terms_of(dictionary: Dictionary, tracked: DataFrame | None = None) -> DataFrame:
    """Every string the matcher looks for, one row each (TERM_COLUMNS)."""
    stocks = with_array_defaults(dictionary.stocks).select(
        "ticker", "aliases", "ambiguous", "supersedes"
    )
    if tracked is not None:
        empty = F.array().cast(NO_STRINGS)
        custom = tracked.select(
            "ticker", empty.alias("aliases"),
            F.filter(F.coalesce(F.from_json("custom_keywords", NO_STRINGS), empty),
                     lambda k: k != "").alias("ambiguous"),
            empty.alias("supersedes"), F.lit(1).alias("_src"))
        both = stocks.withColumn("_src", F.lit(0)).unionByName(custom)

        def joined(name: str) -> Column:
            lists = F.array_sort(F.collect_list(F.struct("_src", name)))
            return F.array_distinct(F.flatten(F.transform(lists, lambda x: x[name]))).alias(name)

        stocks = both.groupBy("ticker").agg(
            joined("aliases"), joined("ambiguous"), joined("supersedes"))
    listed = stocks.select("ticker", "supersedes", F.inline(F.concat(
        F.transform("aliases", lambda a, i: F.struct(
            F.lit("safe").alias("kind"), a.alias("alias"), i.alias("ord"))),
        F.transform("ambiguous", lambda a, i: F.struct(
            F.lit("ambiguous").alias("kind"), a.alias("alias"), i.alias("ord"))),
        F.filter(F.array(F.struct(
            F.lit("symbol").alias("kind"), F.col("ticker").alias("alias"),
            F.lit(-1).alias("ord"))), lambda x: F.length(x["alias"]) >= 2),
    )))
    ctx = dictionary.context_words.select(
        F.lit(None).cast("string").alias("ticker"), F.array().cast(NO_STRINGS).alias("supersedes"),
        F.lit("context").alias("kind"), F.col("word").alias("alias"), F.lit(0).alias("ord"))
    collisions = dictionary.collisions.select("ticker", F.lit(True).alias("collision")).distinct()
    guards = symbol_guards(listed.filter("kind = 'symbol'").select("ticker").distinct())
    return (
        listed.unionByName(ctx).filter(F.col("alias") != "")
        .join(collisions, "ticker", "left").join(guards, "ticker", "left")
        .select("kind", F.when(F.col("kind") == "symbol", F.col("alias")).otherwise(
            F.lower("alias")).alias("term"), "ticker", "alias", "ord",
            F.coalesce("collision", F.lit(False)).alias("collision"), "supersedes",
            F.when(F.col("kind") == "symbol", F.coalesce("guard", F.lit(""))).otherwise("").alias("guard"))
    )


def inlined(terms: DataFrame, limit: int = MAX_INLINE_TERMS) -> tuple[DataFrame | None, list]:
    """The terms as a local relation with their rows, or None when there are more than ``limit``.

    Reads at most ``limit`` + 1 short rows to prove the bound.
    """
    rows = terms.limit(limit + 1).collect()
    if len(rows) > limit:
        return None, []
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in terms.schema.fields)
    return small_table(terms.sparkSession, [tuple(r) for r in rows], ddl), rows
