"""The driver's tables in the roles of a catalog, for the registered queries.

Each role has a DataFrame and the same rows in DuckDB's SQL, as a common table expression. Stored and
incoming states differ by rules on the key, so that all actions occur; every role covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions by role.
SQL = {
    "tracks": """tracks as (
        select 'item:' || case when p_partkey % 11 = 5 then 'local' else 'track' end || ':' || p_partkey as uri,
               case when p_partkey % 11 = 5 then null else 'id' || p_partkey end as track_id,
               p_name || case when p_partkey % 5 = 0 then ' (Extended Mix)' when p_partkey % 5 = 1 then ' - Radio Edit' else '' end as title,
               p_brand || case when p_partkey % 4 = 3 then ', Guest' || (p_partkey % 7) else '' end as artists,
               case when p_partkey % 9 = 0 then '' else p_type end as album,
               cast(p_size as bigint) * 10000 as duration_ms, p_partkey % 11 = 5 as is_local,
               timestamp '2020-01-01' + to_days(cast(p_partkey % 1000 as integer)) as added_at
        from part)""",
    "incoming": """incoming as (
        select uri, track_id, case when p_partkey % 7 = 0 then title || ' II' else title end as title, artists,
               case when p_partkey % 13 = 0 then null else album end as album, duration_ms, is_local, added_at
        from (select t.*, cast(split_part(uri, ':', 3) as bigint) as p_partkey from tracks t) where p_partkey % 10 <> 0
        union all
        select 'item:track:new' || s_suppkey, 'new' || s_suppkey, s_name, 'Brand#' || (s_suppkey % 25), 'NEW', 180000, false, timestamp '2024-01-01'
        from supplier)""",
    "playlists": """playlists as (
        select 'pl' || s_suppkey as playlist_id, s_name as name, 'v' || (s_suppkey % 6) as token from supplier)""",
    "incoming_playlists": """incoming_playlists as (
        select 'pl' || s_suppkey as playlist_id, case when s_suppkey % 8 = 3 then s_name || ' B' else s_name end as name,
               'v' || case when s_suppkey % 3 = 0 then s_suppkey % 5 else s_suppkey % 6 end as token from supplier where s_suppkey % 9 <> 4
        union all select 'plc' || c_custkey, c_name, 'v1' from customer where c_nationkey = 3)""",
    "pairs": """pairs as (
        select distinct 'item:' || case when l_partkey % 11 = 5 then 'local' else 'track' end || ':' || l_partkey as uri, 'pl' || l_suppkey as playlist_id
        from lineitem)""",
    "incoming_pairs": """incoming_pairs as (
        select distinct 'item:' || case when l_partkey % 11 = 5 then 'local' else 'track' end || ':' || l_partkey as uri,
               'pl' || case when l_linenumber = 1 and l_partkey % 3 = 0 then l_suppkey // 2 else l_suppkey end as playlist_id
        from lineitem where l_returnflag <> 'R' or l_partkey % 2 = 0)""",
    "mappings": """mappings as (
        select c_custkey as mapping_id, '/music/' || c_mktsegment || '/' || p_brand || ' - ' || p_name || ' ' || c_custkey || '.mp3' as file_path,
               'item:' || case when p_partkey % 11 = 5 then 'local' else 'track' end || ':' || p_partkey as uri, c_custkey % 13 <> 0 as is_active
        from customer join part on p_partkey = c_custkey * 3 // 4)""",
    "inventory": """inventory as (
        select file_path, cast(mapping_id * 7 % 600 as bigint) * 1000 as duration_ms,
               case when mapping_id % 5 = 0 then '' when mapping_id % 5 = 1 then 'zz' || mapping_id else 'id' || split_part(uri, ':', 3) end as embedded_track_id
        from mappings where mapping_id % 7 <> 2
        union all
        select '/music/new/' || p_brand || ' - ' || p_name || ' ' || s_suppkey || '.' || case s_suppkey % 4 when 0 then 'flac' when 1 then 'wav' when 2 then 'mp3' else 'txt' end,
               cast(s_suppkey % 500 as bigint) * 1000, ''
        from supplier join part on p_partkey = s_suppkey)""",
    "odd_files": """odd_files as (
        select '/music/odd/' || s_suppkey || '/' || case s_suppkey % 6 when 0 then title when 1 then upper(title) when 2 then substr(title, 2)
               when 3 then p_name || 'x' when 4 then p_brand || ' Bnd - ' || p_name else p_brand || ' - ' || p_name || ' (Radio Edit)' end || '.mp3' as file_path,
               cast(s_suppkey % 50 as bigint) * 10000 as duration_ms
        from supplier join (select *, p_name || case when p_partkey % 5 = 0 then ' (Extended Mix)' when p_partkey % 5 = 1 then ' - Radio Edit' else '' end as title from part) p
        on p_partkey = case when s_suppkey % 6 < 3 then s_suppkey // 6 * 11 + 5 else s_suppkey end)""",
    "ratings": """ratings as (
        select 'item:' || case when doc_id % 11 = 5 then 'local' else 'track' end || ':' || doc_id as uri,
               cast(quality * 4 + toxic + 0.5 as double) as rating, case when toxic = 1 then 'high' else 'low' end as energy from labels)""",
}


def with_roles(*roles: str) -> str:
    """A WITH clause for the roles and those that they need."""
    needs = {"incoming": ["tracks"], "inventory": ["mappings"]}
    order: list[str] = []
    for r in roles:
        for x in [*needs.get(r, []), r]:
            if x not in order:
                order.append(x)
    return "with " + ",\n".join(SQL[r] for r in order) + "\n"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uri(key: str):
    kind = F.when(F.col(key) % 11 == 5, F.lit("local")).otherwise(F.lit("track"))
    return F.concat(F.lit("item:"), kind, F.lit(":"), F.col(key).cast("string"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    note = F.when(key % 5 == 0, F.lit(" (Extended Mix)")).when(key % 5 == 1, F.lit(" - Radio Edit")).otherwise(F.lit(""))
    return read(spark, sf_dir, "part").withColumn("title", F.concat("p_name", note))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = _titled(spark, sf_dir), F.col("p_partkey")
    guest = F.when(key % 4 == 3, F.concat(F.lit(", Guest"), (key % 7).cast("string"))).otherwise(F.lit(""))
    return p.select(
        _uri("p_partkey").alias("uri"),
        F.when(key % 11 != 5, F.concat(F.lit("id"), key.cast("string"))).alias("track_id"),
        "title",
        F.concat("p_brand", guest).alias("artists"),
        F.when(key % 9 == 0, F.lit("")).otherwise(F.col("p_type")).alias("album"),
        (F.col("p_size").cast("long") * 10000).alias("duration_ms"),
        (key % 11 == 5).alias("is_local"),
        (F.timestamp_seconds(F.unix_timestamp(F.lit("2020-01-01 00:00:00")) + (key % 1000) * 86400)).alias("added_at"),
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("k", F.split("uri", ":")[2].cast("long")).where("k % 10 <> 0")
    old = t.withColumn("title", F.when(F.col("k") % 7 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title")))
    old = old.withColumn("album", F.when(F.col("k") % 13 != 0, F.col("album"))).drop("k")
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    new = s.select(
        F.concat(F.lit("item:track:new"), key).alias("uri"), F.concat(F.lit("new"), key).alias("track_id"), F.col("s_name").alias("title"),
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("artists"), F.lit("NEW").alias("album"),
        F.lit(180000).cast("long").alias("duration_ms"), F.lit(False).alias("is_local"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("added_at"),
    )
    return old.unionByName(new)


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("pl"), F.col("s_suppkey").cast("string")).alias("playlist_id"), F.col("s_name").alias("name"), F.concat(F.lit("v"), (F.col("s_suppkey") % 6).cast("string")).alias("token"))


def incoming_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").where(key % 9 != 4)
    token = F.when(key % 3 == 0, key % 5).otherwise(key % 6)
    name = F.when(key % 8 == 3, F.concat("s_name", F.lit(" B"))).otherwise(F.col("s_name"))
    old = s.select(F.concat(F.lit("pl"), key.cast("string")).alias("playlist_id"), name.alias("name"), F.concat(F.lit("v"), token.cast("string")).alias("token"))
    new = read(spark, sf_dir, "customer").where("c_nationkey = 3")
    return old.unionByName(new.select(F.concat(F.lit("plc"), F.col("c_custkey").cast("string")).alias("playlist_id"), F.col("c_name").alias("name"), F.lit("v1").alias("token")))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.select(_uri("l_partkey").alias("uri"), F.concat(F.lit("pl"), F.col("l_suppkey").cast("string")).alias("playlist_id"))


def incoming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' or l_partkey % 2 = 0")
    to = F.when((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 3 == 0), F.floor(F.col("l_suppkey") / 2)).otherwise(F.col("l_suppkey"))
    return rows.select("l_partkey", to.alias("to")).distinct().select(_uri("l_partkey").alias("uri"), F.concat(F.lit("pl"), F.col("to").cast("string")).alias("playlist_id"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    both = c.withColumn("p_partkey", F.floor(F.col("c_custkey") * 3 / 4)).join(p, "p_partkey")
    path = F.concat(F.lit("/music/"), "c_mktsegment", F.lit("/"), "p_brand", F.lit(" - "), "p_name", F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".mp3"))
    return both.select(F.col("c_custkey").alias("mapping_id"), path.alias("file_path"), _uri("p_partkey").alias("uri"), (F.col("c_custkey") % 13 != 0).alias("is_active"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mappings(spark, sf_dir).where("mapping_id % 7 <> 2")
    mid = F.col("mapping_id")
    tag = F.when(mid % 5 == 0, F.lit("")).when(mid % 5 == 1, F.concat(F.lit("zz"), mid.cast("string"))).otherwise(F.concat(F.lit("id"), F.split("uri", ":")[2]))
    old = m.select("file_path", ((mid * 7 % 600).cast("long") * 1000).alias("duration_ms"), tag.alias("embedded_track_id"))
    s, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    key = F.col("s_suppkey")
    ext = F.when(key % 4 == 0, "flac").when(key % 4 == 1, "wav").when(key % 4 == 2, "mp3").otherwise("txt")
    path = F.concat(F.lit("/music/new/"), "p_brand", F.lit(" - "), "p_name", F.lit(" "), key.cast("string"), F.lit("."), ext)
    new = s.join(p, s.s_suppkey == p.p_partkey).select(path.alias("file_path"), ((key % 500).cast("long") * 1000).alias("duration_ms"), F.lit("").alias("embedded_track_id"))
    return old.unionByName(new)


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named in the ways that only local tracks, or names without an artist, or misspelt ones, can be linked by."""
    kind = F.col("s_suppkey") % 6
    part = F.when(kind < 3, F.floor(F.col("s_suppkey") / 6) * 11 + 5).otherwise(F.col("s_suppkey"))
    both = read(spark, sf_dir, "supplier").withColumn("p_partkey", part).join(_titled(spark, sf_dir), "p_partkey")
    name = (
        F.when(kind == 0, F.col("title"))
        .when(kind == 1, F.upper("title"))
        .when(kind == 2, F.substring("title", 2, 1000))
        .when(kind == 3, F.concat("p_name", F.lit("x")))
        .when(kind == 4, F.concat("p_brand", F.lit(" Bnd - "), "p_name"))
        .otherwise(F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" (Radio Edit)")))
    )
    path = F.concat(F.lit("/music/odd/"), F.col("s_suppkey").cast("string"), F.lit("/"), name, F.lit(".mp3"))
    return both.select(path.alias("file_path"), ((F.col("s_suppkey") % 50).cast("long") * 10000).alias("duration_ms"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels")
    rating = (F.col("quality") * 4 + F.col("toxic") + F.lit(0.5)).cast("double")
    return rows.select(_uri("doc_id").alias("uri"), rating.alias("rating"), F.when(F.col("toxic") == 1, F.lit("high")).otherwise(F.lit("low")).alias("energy"))
