"""Registered queries: look-ups by name, file plans, collection nodes, and sources and sinks read back from what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import bindings as b
from concordat.bindings import with_roles
from concordat.functions import text as T
from concordat.operators import catalog, linkage, playlists, reconcile, validate
from concordat.plans import exports
from concordat.queries_catalog import _MEMBERS, _member_plan
from concordat.queries_linkage import _ENTRIES, _FOLDERS, _entries, _now, _parsed
from concordat.registry import indel_bits_sql, letters_sql, query
from concordat.sources import feeds, files
from concordat.tables import folder as _folder


# --- look-ups by name ---------------------------------------------------------------------------------------


@query(with_roles("playlists") + "select playlist_id, name from playlists where upper(trim(name)) like 'SUPPLIER#00000001%'")
def flt17_playlists_with_prefix(spark, sf):
    return catalog.with_prefix(b.playlists(spark, sf), "Supplier#00000001").select("playlist_id", "name")


@query(with_roles("playlists") + """, w as (select distinct lpad(cast(c_custkey as varchar), 3, '0') as wanted from customer)
select wanted, playlist_id, name from w left join playlists on contains(lower(name), lower(wanted))""")
def flt18_playlists_of_texts(spark, sf):
    wanted = b.read(spark, sf, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 3, "0").alias("wanted"))
    return catalog.names_containing(b.playlists(spark, sf), wanted)


@query(with_roles("tracks", "mappings", "inventory") + f""", w as (select distinct title, artists, lower(title) as t, lower(trim(split_part(artists, ',', 1))) as a from tracks),
n as (select lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')) as name, min(file_path) as file_path from inventory group by 1),
one as (select title, artists, min(file_path) as file_path from w join n on contains(name, a || ' - ' || t) or contains(name, t || ' - ' || a) or contains(name, a || '_' || t) or contains(name, t) group by 1, 2),
p as (select regexp_replace(name, '[^\\w\\s]', '', 'g') as plain, file_path from n), v as (select *, regexp_replace(t, '[^\\w\\s]', '', 'g') as tt, regexp_replace(a, '[^\\w\\s]', '', 'g') as aa from w),
two as (select title, artists, min(file_path) as file_path from v join p on contains(plain, aa || ' ' || tt) or contains(plain, tt || ' ' || aa)
        where (title, artists) not in (select (title, artists) from one) group by 1, 2),
left_ as (select * from w where (title, artists) not in (select (title, artists) from one union all select (title, artists) from two)),
ways as (select title, artists, a || ' - ' || t as form from left_ union select title, artists, t || ' - ' || a from left_),
{letters_sql('letters_', 'ways', 'form')},
s as (select form, name, {indel_bits_sql('form', 'places', 'name')} as score from letters_, n where levenshtein(form, name) <= 0.3 * (len(form) + len(name)) + 0.001),
three as (select title, artists, arg_min(file_path, (-score, file_path)) as file_path, round(max(score), 6) as score from ways join s using (form) join n using (name) where score > 0.7 group by 1, 2)
select title, artists, file_path, 'contains' as rule, 1.0 :: double as score from one union all select title, artists, file_path, 'cleaned', 1.0 from two union all select title, artists, file_path, 'fuzzy', score from three""")
def jn24_find_files(spark, sf):
    return linkage.find_files(b.tracks(spark, sf), b.inventory(spark, sf))


@query(with_roles("tracks", "mappings", "inventory") + f""", w as (
    select distinct title, artists, lower(regexp_replace(artists || title, '[\\s()\\\\/*?:"<>|]', '', 'g')) as mine from tracks
), n as (
    select distinct lower(regexp_replace(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', ''), '[\\s()\\\\/*?:"<>|]', '', 'g')) as theirs from inventory
), {letters_sql('letters_', 'w', 'mine')},
hit as (select distinct mine from letters_, n where {indel_bits_sql('mine', 'places', 'theirs')} >= 0.5)
select title, artists, mine in (select mine from hit) as found from w""")
def jn25_files_exist(spark, sf):
    return linkage.files_exist(b.tracks(spark, sf), b.inventory(spark, sf))


_WANTED = """w as (select distinct case when mapping_id % 6 = 0 then 'lost ' else '' end || regexp_extract(file_path, '([^/]*)$', 1) as file_name from mappings)"""


def _paths(spark, sf):
    name = F.concat(F.when(F.col("mapping_id") % 6 == 0, F.lit("lost ")).otherwise(F.lit("")), T.file_name(F.col("file_path")))
    return linkage.paths_of_names(b.mappings(spark, sf).select(name.alias("file_name")), b.inventory(spark, sf))


@query(with_roles("mappings", "inventory") + f""", {_WANTED}
select file_name, min(file_path) as file_path from w left join inventory i on regexp_extract(i.file_path, '([^/]*)$', 1) = file_name group by file_name""")
def jn35_paths_of_names(spark, sf):
    return _paths(spark, sf)


@query(with_roles("mappings", "inventory") + f""", {_WANTED}, r as (
    select file_name, min(file_path) as file_path from w left join inventory i on regexp_extract(i.file_path, '([^/]*)$', 1) = file_name group by file_name)
select count(file_path) as succeeded, count(*) - count(file_path) as failed, count(*) as total from r""")
def agg22_outcome_totals(spark, sf):
    return catalog.outcome_totals(_paths(spark, sf), F.col("file_path").isNotNull())


# --- playlist files and the collection ----------------------------------------------------------------------

_PLANNED = _FOLDERS + """, there as (
    select case when n.folder = '' then '' else n.folder || '/' end || p.name || '.m3u' as path from playlists p join now_ n on n.name = p.name where p.token = 'v1'
), planned as (
    select i.playlist_id, p.name, n.folder, case when n.folder = '' then '' else n.folder || '/' end || p.name || '.m3u' as m3u_path from (select distinct playlist_id from incoming_playlists) i
    left join playlists p on p.playlist_id = i.playlist_id left join now_ n on n.name = p.name
), a as (select *, case when name is null then 'unknown' when m3u_path in (select path from there) then 'skip' else 'write' end as action from planned)
"""


def _planned(spark, sf):
    now = _now(spark, sf)
    there = b.playlists(spark, sf).where("token = 'v1'").join(now.select("name", "folder"), "name")
    path = F.concat(F.when(F.col("folder") == "", F.lit("")).otherwise(F.concat("folder", F.lit("/"))), "name", F.lit(".m3u"))
    return playlists.plan_files(b.incoming_playlists(spark, sf), b.playlists(spark, sf), now, there.select(path.alias("path")), overwrite=False)


@query(_PLANNED + "select playlist_id, name, folder, m3u_path, action from a")
def comp26_plan_files(spark, sf):
    return _planned(spark, sf)


@query(_PLANNED + "select count(*) filter (where action = 'write') as succeeded, count(*) filter (where action <> 'write') as failed, count(*) as total from a")
def comp26_plan_totals(spark, sf):
    return catalog.outcome_totals(_planned(spark, sf), F.col("action") == "write")


_NODES = with_roles("playlists", "incoming_playlists", "pairs", "tracks", "mappings", "inventory") + _FOLDERS[_FOLDERS.index(", now_ as"):].rstrip() + _ENTRIES[_ENTRIES.index(", latest as"):].rstrip() + """,
saved as (select folder, name, pos from now_ where name in (select name from incoming_playlists)),
f as (select playlist_id as file, p.name, folder from playlists p join now_ n on n.name = p.name),
fo as (select folder, row_number() over (order by folder) - 1 as fpos from (select distinct folder from saved where folder not like '%1')),
cnt as (select playlist_id as file, count(distinct path) as n from e group by playlist_id),
lists as (select 'playlist' as kind, f.folder, f.name, cast(case when f.folder = '' then -1 else coalesce(fpos, 999) end as integer) as folder_index, cast(coalesce(s.pos, 999) as integer) as index, coalesce(n, 0) as n
          from f left join fo on fo.folder = f.folder left join saved s on s.folder = f.folder and s.name = f.name left join cnt on cnt.file = f.file),
every as (select folder from f where folder <> '' union select split_part(folder, '/', 1) from f where folder <> '' union select ''),
tree as (select 'folder' as kind, x.folder, regexp_extract(x.folder, '([^/]*)$', 1) as name, cast(case when x.folder = '' then -1 else coalesce(fpos, 999) end as integer) as folder_index, cast(-1 as integer) as index,
         (select count(*) from every c where c.folder <> '' and case when contains(c.folder, '/') then split_part(c.folder, '/', 1) else '' end = x.folder) + (select count(*) from f where f.folder = x.folder) as n
         from every x left join fo on fo.folder = x.folder)
"""


def _node_tables(spark, sf):
    return _collection(spark, sf)[1:]


def _collection(spark, sf):
    now = _now(spark, sf)
    saved = now.join(b.incoming_playlists(spark, sf).select("name").distinct(), "name", "left_semi")
    named = saved.select("folder").distinct().where("folder not like '%1'")
    order = named.agg(F.array_sort(F.collect_set("folder")).alias("f")).select(F.posexplode("f").alias("pos", "folder"))
    listed = b.playlists(spark, sf).select(F.col("playlist_id").alias("file"), "name").join(now.select("name", "folder"), "name")
    parsed = _parsed(spark, sf)
    tracks = playlists.collection_tracks(parsed, b.mappings(spark, sf), b.ratings(spark, sf))
    entries = playlists.collection_entries(parsed, tracks)
    return tracks, playlists.collection_nodes(listed, entries, saved, order), listed, entries


@query(_NODES + "select * from lists union all select * from tree")
def comp14_collection_nodes(spark, sf):
    return _node_tables(spark, sf)[0]


@query(_NODES + """select folder, name, 1 as type, n, n as refs from lists union all select folder, name, 0, n, 0 from tree""")
def snk9_collection_xml(spark, sf):
    """The nodes written as XML and read back, with the number of track references."""
    to = _folder(spark, "nodes")
    exports.write_nodes(*_node_tables(spark, sf), to)
    schema = "_Folder string, _Name string, _Type int, _KeyType int, _Entries bigint, _Count bigint, TRACK array<struct<_Key: bigint>>"
    back = spark.read.format("xml").option("rowTag", "NODE").schema(schema).load(to)
    text = lambda c: F.coalesce(c, F.lit(""))
    refs = F.coalesce(F.size(F.array_distinct("TRACK")), F.lit(0))
    return back.select(text(F.col("_Folder")).alias("folder"), text(F.col("_Name")).alias("name"), F.col("_Type").alias("type"), F.coalesce("_Entries", "_Count").alias("n"), F.when(refs > 0, refs).otherwise(F.lit(0)).cast("long").alias("refs"))


@query(_NODES + """, said as (
    select case when folder = '' then 0 else 1 + length(folder) - length(replace(folder, '/', '')) end as depth, '<NODE Name="' || case when folder = '' then 'm3u' else name end || '" Type="0" Count="' || n || '">' as value from tree
    union all select 1 + case when folder = '' then 0 else 1 + length(folder) - length(replace(folder, '/', '')) end, '<NODE Name="' || name || '" Type="1" KeyType="0" Entries="' || n || '">' from lists)
select depth, value from said""")
def snk9_nested_document(spark, sf):
    """One document with nested folders, as sorted lines: those that open a folder or playlist, with their depth."""
    lines = exports.collection_document(*_collection(spark, sf)).where("section = 2")
    return lines.where("line like '<NODE %'").select(F.size("path").cast("long").alias("depth"), F.col("line").alias("value"))


@query(_ENTRIES + """select playlist_id, md5('#EXTM3U' || chr(10) || string_agg('#EXTINF:' || duration || ',' || info || chr(10) || path, chr(10) order by pos)) as content from e group by playlist_id""")
def snk8_playlist_files(spark, sf):
    """Files of all playlists in one batch, read back whole."""
    to = _folder(spark, "playlists")
    exports.write_playlists(playlists.m3u_text(playlists.m3u_lines(_entries(spark, sf))), to)
    back = spark.read.schema("value string, playlist_id string").text(to, wholetext=True)
    return back.select("playlist_id", F.md5(F.regexp_replace("value", "\n$", "")).alias("content"))


# --- sources and reports ------------------------------------------------------------------------------------


@query(with_roles("playlists") + """
select playlist_id, name, token as snapshot_id from playlists where cast(substr(playlist_id, 3) as bigint) % 4 <> 1 and not contains(lower(name), '00003')""")
def src2_playlist_feed(spark, sf):
    p = b.playlists(spark, sf).withColumn("k", F.substring("playlist_id", 3, 20).cast("long"))
    owner = F.struct(F.when(F.col("k") % 4 == 1, "you").otherwise("me").alias("id"))
    item = F.struct(F.col("playlist_id").alias("id"), F.concat(F.lit(" "), "name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("token").alias("snapshot_id"), owner.alias("owner"))
    to = _folder(spark, "pages")
    p.groupBy(F.floor(F.col("k") / 50).alias("page")).agg(F.collect_list(item).alias("items")).select("items").write.json(to)
    out = catalog.excluded(F.col("name"), F.col("playlist_id"), F.col("description"), ["00003"])
    return feeds.playlists(feeds.read_pages(spark, to, feeds.PLAYLIST_PAGE), "me", out).select("playlist_id", "name", "snapshot_id")


def _track_page_rows(spark, sf):
    """Pages of up to a few items for each playlist; items are gathered flat, as nested ones take more room in the shuffle."""
    rows = b.pairs(spark, sf).join(b.tracks(spark, sf), "uri")
    flat = F.struct("uri", "track_id", "title", "artists", "album", "duration_ms", "is_local", "added_at")

    def item(x):
        artists = F.transform(F.split(x["artists"], ", "), lambda a: F.struct(a.alias("name")))
        track = F.struct(x["track_id"].alias("id"), x["title"].alias("name"), x["uri"].alias("uri"), x["is_local"].alias("is_local"), x["duration_ms"].alias("duration_ms"), artists.alias("artists"), F.struct(x["album"].alias("name")).alias("album"))
        return F.struct(F.date_format(x["added_at"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("added_at"), track.alias("track"))

    pages = rows.groupBy("playlist_id", F.pmod(F.xxhash64("uri"), F.lit(8))).agg(F.collect_list(flat).alias("flat"))
    return pages.select("playlist_id", F.transform("flat", item).alias("items"))


def _write_pages(pages, to):
    """One JSON document a line, compressed: as plain text, pages take many times the room of the tables that they come from."""
    pages.write.mode("append").option("compression", "gzip").json(to)


def _track_pages(spark, sf):
    """The pages written as JSON and read again."""
    to = _folder(spark, "pages")
    _write_pages(_track_page_rows(spark, sf), to)
    return feeds.read_pages(spark, to, feeds.TRACK_PAGE)


@query(with_roles("pairs", "tracks") + """
select playlist_id, p.uri, track_id, title, artists, case when album = '' then case when is_local then 'Local File' else '' end else album end as album, added_at, nullif(duration_ms, 0) as duration_ms, is_local
from pairs p join tracks t on t.uri = p.uri""")
def src3_track_feed(spark, sf):
    return feeds.tracks(_track_pages(spark, sf)).drop("pos")


@query(with_roles("pairs", "tracks") + "select playlist_id, p.uri from pairs p join tracks t on t.uri = p.uri")
def src4_member_feed(spark, sf):
    return feeds.members(_track_pages(spark, sf))


@query(with_roles("pairs", "tracks") + """
select playlist_id, case when is_local then 'local_' || left(md5(regexp_replace(lower(artists || '_' || title), '[^\\w]', '', 'g')), 16) else track_id end as key from pairs p join tracks t on t.uri = p.uri""")
def src5_legacy_member_feed(spark, sf):
    return feeds.legacy_members(_track_pages(spark, sf))


@query(with_roles("pairs", "tracks") + "select playlist_id, p.uri, added_at from pairs p join tracks t on t.uri = p.uri where added_at >= timestamp '2021-09-12'")
def src6_liked_feed(spark, sf):
    return feeds.liked(_track_pages(spark, sf)).select("playlist_id", "uri", "added_at")


@query(with_roles("pairs", "tracks") + "select playlist_id, title, split_part(artists, ', ', 1) as artist, album from pairs p join tracks t on t.uri = p.uri")
def src7_first_artists(spark, sf):
    return feeds.first_artists(_track_pages(spark, sf)).drop("pos")


@query(_MEMBERS + "select playlist_id as plan, action, uri from d")
def src14_saved_plans(spark, sf):
    """Membership plans saved one for each playlist, nested for every other one, and read back."""
    item = F.create_map(F.lit("uri"), F.col("uri"))
    plan = _member_plan(spark, sf).groupBy(F.col("playlist_id").alias("plan")).agg(*[F.collect_list(F.when(F.col("action") == a, item)).alias(n) for a, n in (("add", "items_to_add"), ("delete", "items_to_delete"))])
    empty = F.array().cast(reconcile._ITEM).alias("items_to_update")
    to = _folder(spark, "plans")
    odd = F.pmod(F.xxhash64("plan"), F.lit(2)) == 1
    plan.where(odd).select("plan", "items_to_add", empty, "items_to_delete", F.lit(0).alias("unchanged_count")).write.json(to)
    nested = F.struct("items_to_add", empty, "items_to_delete").alias("details")
    plan.where(~odd).select("plan", nested, F.struct(F.lit(0).alias("unchanged")).alias("stats")).write.mode("append").json(to)
    saved = spark.read.schema(f"plan string, {reconcile.PLAN}").json(to)
    return reconcile.plan_items(saved).select("plan", "action", F.col("item")["uri"].alias("uri"))


@query(with_roles("mappings") + "select file_path as key from mappings")
def src17_key_list(spark, sf):
    """Keys written one a line, with blank lines between them, and read back."""
    to = _folder(spark, "keys")
    b.mappings(spark, sf).select(F.concat(F.lit(" "), "file_path", F.lit("\n")).alias("value")).write.text(to)
    return files.keys(spark, to)


@query(with_roles("tracks", "mappings", "inventory") + """, proposed as (
    select distinct file_path, 'item:track:' || (duration_ms // 200 % 3000) as uri from inventory
), now_ as (select file_path, arg_max(uri, mapping_id) as uri from mappings where is_active group by file_path)
select p.file_path, p.uri, md5(p.file_path) as file_hash, length(p.file_path) as file_size from proposed p join tracks t on t.uri = p.uri where p.file_path not in (select file_path from now_)""")
def snk5_new_mappings(spark, sf):
    i = b.inventory(spark, sf)
    number = F.floor(F.col("duration_ms") / 200) % 3000
    proposed = i.select("file_path", F.concat(F.lit("item:track:"), number.cast("string")).alias("uri")).distinct()
    created = linkage.create_mappings(proposed, i, b.tracks(spark, sf), b.mappings(spark, sf))
    facts = i.select("file_path", F.md5("file_path").alias("quick"), F.length("file_path").cast("long").alias("size"), F.lit("2024-01-01").cast("timestamp").alias("modified")).distinct()
    return linkage.mapping_rows(created, facts).select("file_path", "uri", "file_hash", "file_size")


_UNAPPLIED = with_roles("tracks", "ratings", "mappings", "inventory") + """, u as (
    select r.uri, rating, title, artists, case when title is null then 'not_in_catalog' when r.uri not in (select uri from mappings where is_active) then 'no_mapping' else 'not_in_playlists' end as reason
    from ratings r left join tracks t on t.uri = r.uri where r.uri not in (select m.uri from mappings m where is_active and file_path in (select file_path from inventory)))
"""


def _unapplied(spark, sf):
    m = b.mappings(spark, sf)
    applied = catalog.live_mappings(m).join(b.inventory(spark, sf).select("file_path"), "file_path", "left_semi")
    return validate.unapplied_ratings(b.ratings(spark, sf), applied, b.tracks(spark, sf), m)


@query(_UNAPPLIED + "select title is not null as db_match, uri, rating, title, reason from u")
def snk10_unapplied_report(spark, sf):
    to = _folder(spark, "report")
    exports.write_json_report(exports.unapplied_report(_unapplied(spark, sf)), to)
    return spark.read.schema("db_match boolean, uri string, rating double, title string, reason string").json(to)


@query(_UNAPPLIED + "select artists || ' - ' || title || ': ' || reason as value from u where title is not null")
def snk11_text_report(spark, sf):
    to = _folder(spark, "report")
    rows = _unapplied(spark, sf).where("title is not null").drop("title").join(b.tracks(spark, sf).select("uri", "artists", "title"), "uri")
    exports.write_text_report(rows.select("artists", "title", F.col("reason").alias("note")), to)
    return spark.read.text(to)


@query(with_roles("tracks") + "select uri, round_even(100 * length(title) / 64.0 :: double, 1) as share from tracks")
def num11_percent(spark, sf):
    return b.tracks(spark, sf).select("uri", T.percent(F.length("title") / F.lit(64.0)).alias("share"))
