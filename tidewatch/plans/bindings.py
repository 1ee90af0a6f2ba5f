"""The data model bound to the given tables (documents, events, embeddings, ...).

Every frame is a plain lazy view over whole tables; nothing is subset or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalars import rfc3339, uuid5_nil
from tidewatch.operators.embedding import hashing_embedder
from tidewatch.operators.enrichment import outcome
from tidewatch.operators.matching import active_strategies, arrivals, interests
from tidewatch.session import ship_package

DIM = 64


def minute() -> Column:
    return F.expr("interval 1 minute")


def epoch() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def now() -> Column:
    """A fixed time of the run, so that results do not depend on when it ran."""
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def strings(*items) -> Column:
    return F.array(*items).cast("array<string>")


class Tables:
    """Given tables and the entities derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # times of the tables are UTC

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- events -----------------------------------------------------------------

    def events(self, url: bool = True, vector: bool = True) -> DataFrame:
        """Documents as events; ``url`` and ``vector`` add the joins those columns need."""
        arrived = self.raw("events").select(
            F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("published_at"))
        doc = self.raw("documents").join(arrived, "doc_id")
        tickers = F.when(F.col("doc_id") % 7 == 0, strings()).otherwise(
            strings(F.upper("lang"), F.concat(F.lit("T"), F.col("doc_id") % 10)))
        events = doc.select(
            F.col("doc_id").cast("string").alias("id"), "source", tickers.alias("tickers"),
            F.substring("text", 1, 60).alias("title"), F.col("text").alias("raw_text"), "published_at",
            (F.col("published_at") + minute()).alias("ingested_at"), F.col("doc_id").alias("seq"),
        )
        if url:
            pages = self.raw("pages").select(F.col("page_id").alias("seq"), F.col("url").alias("content_url"))
            events = events.join(pages, "seq", "left")
        if vector:
            events = events.join(self.vectors(), "seq", "left")
        return events

    def vectors(self) -> DataFrame:
        """(seq, vector) of every document: its row of ``embeddings``, or else its text, hashed.

        Only a text without any token has none.
        """
        stored = self.raw("embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
        texts = self.raw("documents").select(F.col("doc_id").alias("seq"), "text").join(stored, "seq", "left_anti")
        return stored.unionByName(hashing_embedder(DIM)(texts, "seq", "text"))

    def enriched(self, url: bool = False) -> DataFrame:
        """Events with a vector whose text is long enough."""
        return self.events(url=url).where("vector is not null and octet_length(raw_text) >= 50")

    def arrivals(self) -> DataFrame:
        return arrivals(self.enriched(), "ingested_at", "vector")

    def corpus(self) -> DataFrame:
        return self.enriched().select(uuid5_nil("id").alias("point_id"), F.col("id").alias("event_id"),
                                      "source", "tickers", "vector")

    def with_repeats(self) -> DataFrame:
        """Events, and every sixth one again later under a new title."""
        events = self.events(url=False)
        again = events.where("seq % 6 = 0").withColumns({
            "title": F.concat(F.lit("again: "), F.col("title")),
            "ingested_at": F.col("ingested_at") + F.expr("interval 1 day"),
        })
        return events.unionByName(again)

    def outcomes(self) -> DataFrame:
        """What became of every event: some were not fetched, every eleventh could not be embedded."""
        embedded = F.when(F.col("seq") % 11 != 5, F.col("vector"))
        result = outcome(F.col("seq") % 17 != 3, "raw_text", embedded)
        failed = F.when(F.col("outcome") == "error", F.lit(4)).when(
            F.col("outcome") == "enriched", F.col("seq") % 3).otherwise(F.lit(0))
        return self.events(url=False).withColumn("outcome", result).withColumn("failed_calls", failed)

    # -- registry ---------------------------------------------------------------

    def users(self) -> DataFrame:
        address = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("id"), address.alias("email"), F.col("c_custkey").alias("seq"))

    def strategies(self) -> DataFrame:
        """One strategy per vector; its query text comes from the benchmark items in turn."""
        bench = self.raw("benchmark")
        items = bench.agg(F.count(F.lit(1))).scalar()
        queries = bench.select(F.col("item_id").alias("_item"), F.col("text").alias("query"))
        g = F.col("vec_id")
        first_ten = strings(*[F.lit(f"src{i}") for i in range(10)])
        source = F.when(g % 3 == 0, strings()).when(g % 3 == 1, first_ten).otherwise(
            strings(F.concat(F.lit("src"), g % 20)))
        tickers = F.when(g % 4 == 0, strings(F.lit("EN"), F.lit("DE"))).when(
            g % 4 == 1, strings(F.lit("T1"), F.lit("T2"), F.lit("T3"))).otherwise(strings())
        return (
            self.raw("embeddings").withColumn("_item", g % items).join(queries, "_item", "left").select(
                g.cast("string").alias("id"), (g % 20).cast("string").alias("user_id"),
                F.concat(F.lit("strategy "), g).alias("name"), F.concat(F.lit("watch "), g).alias("description"),
                "query", source.alias("source"), tickers.alias("tickers"),
                ((g % 4) / F.lit(10.0)).alias("similarity_threshold"), (g % 5 != 4).alias("is_active"),
                (epoch() + F.make_dt_interval(mins=g)).alias("created_at"),
                (epoch() + F.make_dt_interval(mins=g)).alias("updated_at"),
                F.col("embedding").alias("query_vector"), g.alias("seq"),
            )
        )

    def active(self) -> DataFrame:
        return active_strategies(self.strategies(), self.users())

    def interests(self) -> DataFrame:
        return interests(self.active(), "query_vector")

    # -- requests and keys ------------------------------------------------------

    def strategy_requests(self) -> DataFrame:
        """Registry rows as JSON bodies: every tenth cut short, every eleventh without a query."""
        fields = ["name", "description", "source", "tickers", "similarity_threshold"]
        query = F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("query")).alias("query")
        active = F.when(F.col("seq") % 3 != 0, F.col("is_active")).alias("is_active")
        body = F.to_json(F.struct(*fields, query, active))
        cut = F.when(F.col("seq") % 10 == 0, F.expr("substr(body, 1, length(body) - 5)")).otherwise(F.col("body"))
        rows = self.strategies().withColumn("body", body).withColumn("body", cut)
        return rows.select(F.col("id").alias("request_id"), "user_id", "body")

    def key_requests(self) -> DataFrame:
        """One key per customer, a third for an unknown provider, every fourth replaced later."""
        k = F.col("c_custkey")
        provider = F.when(k % 3 == 0, "polygon").when(k % 3 == 1, "openai").otherwise("other")
        first = self.raw("customer").select(
            k.cast("string").alias("user_id"), provider.alias("provider"),
            F.concat(F.lit("key "), k).alias("encrypted_key"),
            (epoch() + F.make_dt_interval(mins=k)).alias("created_at"), k.alias("seq"))
        later = first.where("seq % 4 = 0").withColumns({
            "encrypted_key": F.concat(F.lit("new "), F.col("encrypted_key")),
            "created_at": F.col("created_at") + F.expr("interval 1 day")})
        return first.unionByName(later)

    def keys(self) -> DataFrame:
        """Keys already stored: an old one for every customer."""
        k = F.col("c_custkey")
        pair = F.concat_ws(":", k.cast("string"), "provider")
        return (
            self.raw("customer")
            .withColumn("provider", F.when(k % 2 == 0, "polygon").otherwise("openai"))
            .select(uuid5_nil(pair).alias("id"), k.cast("string").alias("user_id"), "provider",
                    F.concat(F.lit("old "), k).alias("encrypted_key"),
                    (epoch() - F.expr("interval 1 day")).alias("created_at"))
        )

    def user_requests(self) -> DataFrame:
        """Registration requests: every customer's address, every eighth one twice."""
        once = self.users().select("email", "seq")
        twice = once.where("seq % 8 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
        return once.unionByName(twice)

    # -- feeds ------------------------------------------------------------------

    def filings(self) -> DataFrame:
        """Orders as filings; some titles without, with padded or with shadowed CIK."""
        o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
        paren = (
            F.when(o % 13 == 0, "")
            .when(o % 11 == 0, F.concat(F.lit(" (DE) ("), c, F.lit(") (Filer)")))
            .when(o % 10 == 0, F.concat(F.lit(" ("), F.lpad(c, 10, "0"), F.lit(") (Filer)")))
            .otherwise(F.concat(F.lit(" ("), c, F.lit(") (Filer)")))
        )
        names = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
        return self.raw("orders").join(names, "o_custkey").select(
            o.cast("string").alias("guid"), F.concat(F.lit("8-K - "), F.col("c_name"), paren).alias("title"),
            F.concat(F.lit("https://filings.example/"), o).alias("link"),
            F.col("o_orderdate").cast("timestamp").alias("published"), o.alias("seq"))

    def company_documents(self) -> DataFrame:
        """Company objects as JSON text, one or two per customer."""
        k = F.col("c_custkey")

        def entry(letter: str) -> Column:
            return F.struct(k.alias("cik_str"), F.concat(F.lit(letter), k).alias("ticker"), F.col("c_name").alias("title"))

        entries = F.filter(
            F.array(F.when(k % 4 != 0, entry("C")), F.when(k % 9 == 0, entry("D"))), lambda e: e.isNotNull())
        named = F.map_from_entries(F.transform(entries, lambda e, i: F.struct(i.cast("string"), e)))
        return self.raw("customer").select(F.to_json(named).alias("value"))

    def news_lines(self) -> DataFrame:
        """Events as JSON lines; a tenth of them also arrive broken off."""
        item = F.struct("id", "tickers", "title", F.col("content_url").alias("article_url"),
                        rfc3339("published_at").alias("published_utc"))
        lines = self.events(vector=False).select("ingested_at", F.to_json(item).alias("value"), "seq")
        broken = lines.where("seq % 10 = 0").withColumn("value", F.expr("substr(value, 1, 15)"))
        return lines.unionByName(broken).drop("seq")
