"""Registered queries: look-ups, joins, counts, reconciliation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import bindings as b
from concordat import registry
from concordat.bindings import with_roles
from concordat.functions import text as T
from concordat.operators import catalog, duplicates, reconcile
from concordat.plans import stored, versions
from concordat.registry import query
from concordat.tables import folder


@query(with_roles("playlists", "pairs") + """
select p.playlist_id, name, count(uri) as n from playlists p left join pairs m on p.playlist_id = m.playlist_id
group by p.playlist_id, name""")
def agg1_members_per_playlist(spark, sf):
    out = catalog.count_per(b.playlists(spark, sf).select("playlist_id", "name"), b.pairs(spark, sf), "playlist_id", "uri", "n")
    return out.orderBy(F.desc("n"), "name")


@query(with_roles("tracks", "pairs") + "select t.uri, count(playlist_id) as n from tracks t left join pairs m on t.uri = m.uri group by t.uri")
def agg2_playlists_per_track(spark, sf):
    return catalog.count_per(b.tracks(spark, sf).select("uri"), b.pairs(spark, sf), "uri", "playlist_id", "n")


@query(with_roles("incoming_playlists", "pairs") + """
select i.playlist_id, count(uri) as n from incoming_playlists i left join pairs m on i.playlist_id = m.playlist_id group by i.playlist_id""")
def agg3_counts_for_keys(spark, sf):
    return catalog.count_per(b.incoming_playlists(spark, sf).select("playlist_id"), b.pairs(spark, sf), "playlist_id", "uri", "n")


@query(with_roles("playlists", "pairs", "mappings") + """
select p.playlist_id, count(m.uri) as total, count(f.uri) as local from playlists p left join pairs m on p.playlist_id = m.playlist_id
left join (select distinct uri from mappings where is_active) f on f.uri = m.uri group by p.playlist_id""")
def agg4_available_per_playlist(spark, sf):
    return catalog.available_per(b.playlists(spark, sf), b.pairs(spark, sf), b.mappings(spark, sf))


@query(with_roles("mappings") + "select uri, count(*) as n from mappings where is_active group by uri")
def agg5_files_per_uri(spark, sf):
    return catalog.live_mappings(b.mappings(spark, sf)).groupBy("uri").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("mappings") + """
select uri, string_agg(file_path, '|' order by file_path) as files, count(*) as n from mappings where is_active group by uri having count(*) > 1""")
def agg6_duplicate_mappings(spark, sf):
    return duplicates.files_per_uri(b.mappings(spark, sf)).select("uri", F.array_join("files", "|").alias("files"), "n")


@query(with_roles("mappings") + "select distinct uri from mappings where is_active")
def agg7_mapped_uris(spark, sf):
    return catalog.live_mappings(b.mappings(spark, sf)).select("uri").distinct()


@query(with_roles("incoming_playlists", "pairs") + """
select i.playlist_id, coalesce(string_agg(uri, '|' order by uri), '') as uris from incoming_playlists i
left join pairs m on i.playlist_id = m.playlist_id group by i.playlist_id""")
def agg8_uris_per_playlist(spark, sf):
    out = catalog.members_of(b.incoming_playlists(spark, sf), b.pairs(spark, sf), "playlist_id", "uri")
    return out.select("playlist_id", F.array_join("children", "|").alias("uris"))


@query(with_roles("pairs") + "select uri, string_agg(playlist_id, '|' order by playlist_id) as playlists from pairs group by uri")
def agg9_playlists_of_uri(spark, sf):
    rows = b.pairs(spark, sf).groupBy("uri").agg(F.array_sort(F.collect_set("playlist_id")).alias("p"))
    return rows.select("uri", F.array_join("p", "|").alias("playlists"))


@query(with_roles("tracks", "playlists") + """
select (select count(*) from playlists) as playlists, (select count(track_id) from tracks) as tracks_with_id""")
def agg10_global_counts(spark, sf):
    lists = b.playlists(spark, sf).agg(F.count(F.lit(1)).alias("playlists"))
    return lists.crossJoin(b.tracks(spark, sf).agg(F.count("track_id").alias("tracks_with_id")))


@query(with_roles("mappings") + "select uri, arg_max(file_path, mapping_id) as file_path from mappings where is_active group by uri")
def agg11_latest_file(spark, sf):
    return catalog.latest_file(b.mappings(spark, sf))


@query(with_roles("tracks", "pairs") + """
select count(m.uri) as with_parent, count(*) - count(m.uri) as without_parent, (select count(*) from pairs) as pairs
from tracks t left join (select distinct uri from pairs) m on t.uri = m.uri""")
def agg13_membership_stats(spark, sf):
    return reconcile.membership_stats(b.pairs(spark, sf), b.tracks(spark, sf), "uri")


@query(with_roles("tracks", "mappings") + "select t.* from tracks t where uri in (select uri from mappings)")
def flt1_rows_by_key(spark, sf):
    return catalog.by_keys(b.tracks(spark, sf), b.mappings(spark, sf), "uri")


@query(with_roles("tracks") + "select uri, title, artists from tracks where lower(title) like '%widget%' and lower(artists) like '%brand#1%'")
def flt4_title_and_artist(spark, sf):
    return catalog.containing(b.tracks(spark, sf), {"title": "WIDGET", "artists": "brand#1"}).select("uri", "title", "artists")


@query(with_roles("tracks") + "select uri, added_at from tracks where added_at >= timestamp '2021-09-12'")
def flt5_added_since(spark, sf):
    cut = F.lit("2021-09-12 00:00:00").cast("timestamp")
    return catalog.since(b.tracks(spark, sf), "added_at", cut).select("uri", "added_at").orderBy(F.desc("added_at"), "uri")


@query("""
select c_custkey, c_name from customer where not (lower(c_name) like '%7%' or c_name = 'Customer#000000011' or c_custkey in (3, 5)
or regexp_matches(lower(c_mktsegment), '\\bmachinery\\b')) and upper(c_name) <> 'MASTER'""")
def flt6_exclusions(spark, sf):
    c = b.read(spark, sf, "customer")
    out = catalog.excluded(F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment"), ["7"], ["Customer#000000011"], [3, 5], ["Machinery"])
    return c.where(~out & (F.upper("c_name") != "MASTER")).select("c_custkey", "c_name")


@query(with_roles("mappings") + "select mapping_id, file_path, uri from mappings where is_active and uri is not null")
def flt11_live_mappings(spark, sf):
    return catalog.live_mappings(b.mappings(spark, sf)).select("mapping_id", "file_path", "uri")


@query(with_roles("tracks") + """
select case when uri like 'item:local:%' then 'local' when uri like 'item:track:%' then 'track' else 'other' end as kind,
       count(*) as n, count(track_id) as with_id from tracks group by 1""")
def flt13_uri_kinds(spark, sf):
    return b.tracks(spark, sf).groupBy(T.uri_kind(F.col("uri")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("track_id").alias("with_id"))


@query(with_roles("tracks") + "select uri, title, artists, album from tracks where track_id is null")
def flt19_null_keys(spark, sf):
    return b.tracks(spark, sf).where("track_id is null").select("uri", "title", "artists", "album")


@query(with_roles("tracks") + "select track_id as id, title as name, artists, album, added_at from tracks")
def flt20_catalog_rows(spark, sf):
    return b.tracks(spark, sf).select(F.col("track_id").alias("id"), F.col("title").alias("name"), "artists", "album", "added_at")


@query(with_roles("tracks") + """
select uri, artists || ' - ' || title as label, case when album = '' then 'Unknown Album' else album end as album,
       case when duration_ms = 0 then 'Unknown' else (duration_ms // 60000) || ':' || lpad(cast(duration_ms // 1000 % 60 as varchar), 2, '0') end as length
from tracks""")
def flt24_report_rows(spark, sf):
    return b.tracks(spark, sf).select("uri", T.display_name(F.col("artists"), F.col("title")).alias("label"), T.album_label(F.col("album")).alias("album"), T.duration_label(F.col("duration_ms")).alias("length"))


@query(with_roles("tracks", "pairs") + "select playlist_id, t.uri, title from tracks t join pairs m on t.uri = m.uri")
def jn1_tracks_in_playlists(spark, sf):
    return b.pairs(spark, sf).join(b.tracks(spark, sf).select("uri", "title"), "uri").select("playlist_id", "uri", "title")


@query(with_roles("tracks", "incoming", "incoming_pairs") + "select uri from incoming where uri not in (select uri from incoming_pairs)")
def jn2_tracks_in_no_playlist(spark, sf):
    return catalog.without_keys(b.incoming(spark, sf), b.incoming_pairs(spark, sf), "uri").select("uri")


@query(with_roles("playlists", "pairs") + "select uri, p.playlist_id, name from playlists p join pairs m on p.playlist_id = m.playlist_id")
def jn3_playlists_of_tracks(spark, sf):
    return b.pairs(spark, sf).join(b.playlists(spark, sf).select("playlist_id", "name"), "playlist_id").select("uri", "playlist_id", "name")


@query(with_roles("playlists", "incoming_playlists") + """
select i.playlist_id from incoming_playlists i left join playlists p on p.playlist_id = i.playlist_id where p.playlist_id is null or p.token <> i.token""")
def jn6_changed_parents(spark, sf):
    return reconcile.changed_parents(b.playlists(spark, sf), b.incoming_playlists(spark, sf), "playlist_id", "token")


@query(with_roles("playlists") + """, wanted as (
    select distinct case c_custkey % 4 when 0 then 'Supplier#' || lpad(cast(c_custkey as varchar), 9, '0') when 1 then 'supplier#' || lpad(cast(c_custkey as varchar), 9, '0')
           when 2 then lpad(cast(c_custkey as varchar), 6, '0') else c_name end as wanted from customer
), s as (
    select wanted, (select min(playlist_id) from playlists where name = wanted) as id1, (select min(playlist_id) from playlists where lower(name) = lower(wanted)) as id2,
           (select case when count(*) = 1 then min(playlist_id) end from playlists where contains(lower(name), lower(wanted))) as id3 from wanted
) select wanted, coalesce(id1, id2, id3) as playlist_id,
         case when id1 is not null then 'exact' when id2 is not null then 'case' when id3 is not null then 'contains' else 'none' end as rule from s""")
def jn9_find_by_name(spark, sf):
    c = b.read(spark, sf, "customer")
    key, long = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    wanted = F.when(key % 4 == 0, F.concat(F.lit("Supplier#"), long)).when(key % 4 == 1, F.concat(F.lit("supplier#"), long)).when(key % 4 == 2, F.lpad(key.cast("string"), 6, "0")).otherwise(F.col("c_name"))
    return catalog.find_by_name(c.select(wanted.alias("wanted")), b.playlists(spark, sf))


@query(with_roles("tracks", "mappings", "inventory") + """
select uri, added_at from tracks where uri not in (select uri from mappings where is_active and file_path in (select file_path from inventory))""")
def jn10_missing_tracks(spark, sf):
    out = catalog.missing_tracks(b.tracks(spark, sf), b.mappings(spark, sf), b.inventory(spark, sf))
    return out.select("uri", "added_at").orderBy(F.desc_nulls_last("added_at"), "uri")


@query(with_roles("mappings", "inventory") + "select mapping_id, file_path from mappings where is_active and file_path not in (select file_path from inventory)")
def jn12_stale_mappings(spark, sf):
    return catalog.stale_mappings(b.mappings(spark, sf), b.inventory(spark, sf)).select("mapping_id", "file_path")


@query(with_roles("mappings", "inventory") + """
select mapping_id, uri, is_active and file_path in (select file_path from inventory) as is_active from mappings""")
def snk6_soft_delete(spark, sf):
    m = b.mappings(spark, sf)
    return catalog.soft_delete(m, catalog.stale_mappings(m, b.inventory(spark, sf))).select("mapping_id", "uri", "is_active")


@query(with_roles("mappings", "inventory") + "select file_path from inventory where lower(file_path) not in (select lower(file_path) from mappings where is_active)")
def jn13_unmapped_files(spark, sf):
    return catalog.unmapped_files(b.inventory(spark, sf), b.mappings(spark, sf)).select("file_path")


@query(with_roles("inventory") + """
select file_path, min(uri) filter (where k = 1) as uri from (
    select i.file_path, m.uri, row_number() over (partition by i.file_path order by m.mapping_id desc) as k
    from inventory i left join mappings m on m.file_path = i.file_path and m.is_active) group by file_path""")
def jn34_uri_of_paths(spark, sf):
    known = catalog.live_mappings(b.mappings(spark, sf)).groupBy("file_path").agg(F.max_by("uri", "mapping_id").alias("uri"))
    return b.inventory(spark, sf).select("file_path").join(known, "file_path", "left")


_DIFF = with_roles("tracks", "incoming") + """, d as (
    select coalesce(o.uri, n.uri) as uri, case when o.uri is null then 'add' when n.uri is null then 'delete'
           when o.title is distinct from n.title or o.artists is distinct from n.artists or coalesce(nullif(o.album, ''), 'Unknown Album') <> coalesce(nullif(n.album, ''), 'Unknown Album')
                or o.duration_ms is distinct from n.duration_ms then 'update' else 'unchanged' end as action,
           o.title as old_title, n.title as new_title, o.album as old_album, n.album as new_album
    from tracks o full join incoming n on o.uri = n.uri)
"""
_COMPARE = ["title", "artists", "album", "duration_ms"]


def _track_plan(spark, sf):
    return reconcile.snapshot_diff(b.tracks(spark, sf), b.incoming(spark, sf), "uri", _COMPARE, ["added_at"], {"album": T.album_label})


@query(_DIFF + "select * from d")
def comp2_track_diff(spark, sf):
    return _track_plan(spark, sf).select("uri", "action", "old_title", "new_title", "old_album", "new_album")


@query(_DIFF + """select count(*) filter (where action = 'add') as added, count(*) filter (where action = 'update') as updated,
count(*) filter (where action = 'delete') as deleted, count(*) filter (where action = 'unchanged') as unchanged from d""")
def agg12_sync_stats(spark, sf):
    return reconcile.plan_stats(_track_plan(spark, sf))


@query(_DIFF + """
select uri, 'title: ''' || old_title || ''' → ''' || new_title || '''' as change from d where action = 'update' and old_title <> new_title""")
def str29_change_notes(spark, sf):
    plan = _track_plan(spark, sf).where("action = 'update'")
    return plan.select("uri", F.explode("changes").alias("change")).where(F.startswith("change", F.lit("title:")))


@query(with_roles("tracks", "incoming") + "select uri, title, artists, album, duration_ms from incoming")
def comp3_apply_snapshot(spark, sf):
    stored, compare = b.tracks(spark, sf), ["title", "artists", "album", "duration_ms"]
    plan = reconcile.snapshot_diff(stored, b.incoming(spark, sf), "uri", compare, ["added_at", "is_local", "track_id"])
    return reconcile.apply_snapshot(stored, plan, "uri", compare, ["added_at", "is_local", "track_id"]).select("uri", *compare)


@query(with_roles("playlists", "incoming_playlists") + """
select coalesce(o.playlist_id, n.playlist_id) as playlist_id, case when o.playlist_id is null then 'add' when n.playlist_id is null then 'delete'
       when o.name <> n.name or o.token <> n.token then 'update' else 'unchanged' end as action
from playlists o full join incoming_playlists n on o.playlist_id = n.playlist_id""")
def comp1_playlist_diff(spark, sf):
    plan = reconcile.snapshot_diff(b.playlists(spark, sf), b.incoming_playlists(spark, sf), "playlist_id", ["name", "token"])
    return plan.select("playlist_id", "action")


_MEMBERS = with_roles("playlists", "incoming_playlists", "tracks", "pairs", "incoming_pairs") + """, changed as (
    select i.playlist_id from incoming_playlists i left join playlists p on p.playlist_id = i.playlist_id where p.playlist_id is null or p.token <> i.token
), o as (select * from pairs where playlist_id in (select playlist_id from changed)),
n as (select * from incoming_pairs where playlist_id in (select playlist_id from changed) and uri in (select uri from tracks)),
d as (select uri, playlist_id, 'add' as action from (select * from n except select * from o)
      union all select uri, playlist_id, 'delete' from (select * from o except select * from n))
"""


def _member_plan(spark, sf):
    changed = reconcile.changed_parents(b.playlists(spark, sf), b.incoming_playlists(spark, sf), "playlist_id", "token")
    return reconcile.membership_diff(b.pairs(spark, sf), b.incoming_pairs(spark, sf), b.tracks(spark, sf), changed, "uri", "playlist_id")


@query(_MEMBERS + "select * from d")
def comp4_membership_diff(spark, sf):
    return _member_plan(spark, sf)


@query(_MEMBERS + """select uri, coalesce(string_agg(playlist_id, '|' order by playlist_id) filter (where action = 'add'), '') as add_to,
coalesce(string_agg(playlist_id, '|' order by playlist_id) filter (where action = 'delete'), '') as remove_from from d group by uri""")
def comp4_membership_changes(spark, sf):
    out = reconcile.membership_changes(_member_plan(spark, sf), "uri", "playlist_id")
    return out.select("uri", F.array_join("add_to", "|").alias("add_to"), F.array_join("remove_from", "|").alias("remove_from"))


@query(_MEMBERS + "select uri, playlist_id from pairs except select uri, playlist_id from d where action = 'delete' union select uri, playlist_id from d where action = 'add'")
def comp5_apply_membership(spark, sf):
    return reconcile.apply_membership(b.pairs(spark, sf), _member_plan(spark, sf), "uri", "playlist_id")


@query(with_roles("playlists", "incoming_playlists") + """
select p.playlist_id, p.name, coalesce(i.token, p.token) as token from playlists p left join incoming_playlists i on p.playlist_id = i.playlist_id""")
def comp5_store_tokens(spark, sf):
    return reconcile.store_tokens(b.playlists(spark, sf), b.incoming_playlists(spark, sf), "playlist_id", "token")


@query(with_roles("tracks", "incoming", "playlists", "incoming_playlists", "pairs", "incoming_pairs") + """, changed as (
    select i.playlist_id from incoming_playlists i left join playlists p on p.playlist_id = i.playlist_id where p.playlist_id is null or p.token <> i.token
), base as (select * from pairs where playlist_id in (select playlist_id from incoming_playlists) and uri in (select uri from incoming))
select uri, playlist_id from base where playlist_id not in (select playlist_id from changed)
union select uri, playlist_id from incoming_pairs where playlist_id in (select playlist_id from changed) and uri in (select uri from incoming)""")
def comp24_staged_sync(spark, sf):
    old = {"playlists": b.playlists(spark, sf), "tracks": b.tracks(spark, sf), "pairs": b.pairs(spark, sf)}
    new = {"playlists": b.incoming_playlists(spark, sf), "tracks": b.incoming(spark, sf), "pairs": b.incoming_pairs(spark, sf)}
    return versions.staged_sync(old, new)["pairs"]


@query(registry.SQL["comp24_staged_sync"].replace("select uri, playlist_id from base where", "select 'pair' as kind, uri as key, playlist_id as value from base where").replace("union select uri, playlist_id from incoming_pairs", "union select 'pair', uri, playlist_id from incoming_pairs") + """
union all select 'track', uri, title from incoming union all select 'playlist', playlist_id, name || ' ' || token from incoming_playlists""")
def comp24_stored_plan(spark, sf):
    """A plan made from the stored state, kept, and applied later from what was kept: all three tables of the new state."""
    to = folder(spark, "catalog")
    stored.publish(spark, to, {"playlists": b.playlists(spark, sf), "tracks": b.tracks(spark, sf), "pairs": b.pairs(spark, sf)}, after=0)
    _, old = stored.current(spark, to)
    new = {"playlists": b.incoming_playlists(spark, sf), "tracks": b.incoming(spark, sf), "pairs": b.incoming_pairs(spark, sf)}
    stored.save_plan(spark, f"{to}/plans/sync", versions.plan_sync(old, new), old)
    stored.apply_saved(spark, to, f"{to}/plans/sync", versions.apply_sync)
    _, now = stored.current(spark, to)
    rows = [
        now["pairs"].select(F.lit("pair").alias("kind"), F.col("uri").alias("key"), F.col("playlist_id").alias("value")),
        now["tracks"].select(F.lit("track").alias("kind"), F.col("uri").alias("key"), F.col("title").alias("value")),
        now["playlists"].select(F.lit("playlist").alias("kind"), F.col("playlist_id").alias("key"), F.concat_ws(" ", "name", "token").alias("value")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
select user_id, event_type, ts, event_id from (
    select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1""")
def win1_first_seen(spark, sf):
    e = b.read(spark, sf, "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return reconcile.first_seen(e, "key", "ts", "event_id").select("user_id", "event_type", "ts", "event_id")


@query(with_roles("mappings", "incoming_pairs") + "select distinct uri from incoming_pairs where uri not in (select uri from mappings)")
def set3_master_delta(spark, sf):
    return reconcile.delta(b.incoming_pairs(spark, sf), b.mappings(spark, sf), "uri")


@query(with_roles("tracks", "incoming_pairs", "mappings") + """, filed as (select uri from incoming_pairs), unsorted as (select uri from mappings)
select distinct uri, 'add' as action from tracks where uri not in (select uri from filed union select uri from unsorted)
union all select distinct uri, 'delete' from unsorted where uri in (select uri from filed)""")
def comp19_unsorted_delta(spark, sf):
    return reconcile.sort_out(b.tracks(spark, sf), b.incoming_pairs(spark, sf), b.mappings(spark, sf), "uri")


@query(with_roles("tracks") + "select cast((row_number() over (order by uri) - 1) // 100 as bigint) as batch_no, uri from tracks")
def snk15_batches(spark, sf):
    return reconcile.batches(b.tracks(spark, sf), "uri", 100)


@query(with_roles("tracks", "incoming") + """
select uri, track_id, title from tracks union all select uri, track_id, title from incoming where uri not in (select uri from tracks)""")
def snk1_insert_new(spark, sf):
    cols = ["uri", "track_id", "title"]
    return versions.insert_new(b.tracks(spark, sf).select(*cols), b.incoming(spark, sf).select(*cols), ["uri"])


@query(with_roles("tracks", "incoming") + """
select t.uri, case when i.uri is not null then i.title else t.title end as title, case when i.uri is not null then i.album else t.album end as album
from tracks t left join incoming i on t.uri = i.uri""")
def snk2_update_by_key(spark, sf):
    return versions.update_by_key(b.tracks(spark, sf).select("uri", "title", "album"), b.incoming(spark, sf), "uri", ["title", "album"])


@query(with_roles("tracks", "mappings") + "select uri, title from tracks where uri not in (select uri from mappings where not is_active)")
def snk3_delete_keys(spark, sf):
    return versions.delete_keys(b.tracks(spark, sf), b.mappings(spark, sf).where("not is_active"), "uri").select("uri", "title")


@query("""
select event_id, k, k2 from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_object('k', cast(json_extract_string(props, '$.k') as bigint)) :: varchar as k2 from events)""")
def jsn1_event_props(spark, sf):
    rows = b.read(spark, sf, "events").withColumn("j", F.from_json("props", "k bigint"))
    return rows.select("event_id", F.col("j.k").alias("k"), F.to_json("j").alias("k2"))


@query("""
select page_id, regexp_extract(url, '([^/]*)$', 1) as name, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\\.([^.]+)$', 1)) as ext,
       regexp_replace(url, '/?[^/]*$', '') as folder, 'file://localhost/' || url as location from pages""")
def str24_paths(spark, sf):
    url = F.col("url")
    return b.read(spark, sf, "pages").select("page_id", T.file_name(url).alias("name"), T.extension(url).alias("ext"), T.folder_of(url).alias("folder"), T.location_uri(url).alias("location"))
