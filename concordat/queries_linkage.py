"""Registered queries: scalar rules, linkage, duplicates, playlists, folders, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat import bindings as b
from concordat import registry
from concordat.bindings import with_roles
from concordat.functions import text as T
from concordat.functions.similarity import edit_similarity, indel_ratio, matching_blocks_ratio, strip_accents
from concordat.operators import catalog, duplicates, hierarchy, linkage, playlists, validate
from concordat.plans import exports
from concordat.registry import blocks_sql, indel_sql, query
from concordat.streaming import gates
from concordat.tables import folder, staged

# --- scalar rules -------------------------------------------------------------------------------------------


@query(with_roles("tracks", "mappings") + f""", pairs_ as (
    select distinct lower(artists || ' - ' || title) as a, lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')) as b from tracks t join mappings m on m.uri = t.uri)
select a, b, round({indel_sql('a', 'b')}, 6) as ratio, round(1 - levenshtein(a, b) / greatest(len(a), len(b))::double, 6) as edits from pairs_""")
def fn1_ratios(spark, sf):
    both = _names_of_mapped(spark, sf)
    return both.select("a", "b", F.round(indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(edit_similarity(F.col("a"), F.col("b")), 6).alias("edits"))


def _names_of_mapped(spark, sf):
    """(a, b): the expected and the real name of each mapped file."""
    t = b.tracks(spark, sf).select("uri", F.lower(T.display_name(F.col("artists"), F.col("title"))).alias("a"))
    return b.mappings(spark, sf).join(t, "uri").select("a", F.lower(T.stem(F.col("file_path"))).alias("b")).distinct()


@query("select doc_id, md5(strip_accents(text)) as plain from documents")
def fn2_strip_accents(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", F.md5(strip_accents(F.col("text"))).alias("plain"))


@query(with_roles("tracks", "mappings").replace("with ", "with recursive ", 1) + f""", pairs_ as (
    select distinct lower(artists || ' - ' || title) as a, lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')) as b from tracks t join mappings m on m.uri = t.uri),
{blocks_sql('blocks', 'pairs_', 'a', 'b')} select a, b, round(ratio, 9) as ratio from blocks""")
def fn3_matching_blocks(spark, sf):
    return _names_of_mapped(spark, sf).select("a", "b", F.round(matching_blocks_ratio(F.col("a"), F.col("b")), 9).alias("ratio"))


@query(with_roles("tracks") + """
select uri, case when contains(title, ' - ') then split_part(title, ' - ', 1) else '' end as artist,
       case when contains(title, ' - ') then substr(title, instr(title, ' - ') + 3) else title end as title,
       trim(regexp_replace(lower(title), '\\s*\\(extended mix\\)|\\s*-\\s*radio edit$', '')) as base,
       case when lower(title) like '%(extended mix)' then 'extended mix' when lower(title) like '% - radio edit' then 'radio edit' else '' end as version,
       regexp_replace(regexp_replace(lower(regexp_replace(title, '\\s*\\(.*\\)', '')), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g') as finger,
       case when lower(title) like '%extended%' then 'Extended Mix' when lower(title) like '%edit%' then 'Radio Edit' else 'Unknown' end as mix,
       regexp_replace(title, '[^\\w ]', '', 'g') as page
from tracks""")
def str1_title_rules(spark, sf):
    title = F.col("title")
    parts, split = T.split_artist_title(title), T.version_split(F.lower(title))
    return b.tracks(spark, sf).select(
        "uri", parts["artist"].alias("artist"), parts["title"].alias("title"), split["base"].alias("base"), split["version"].alias("version"),
        T.fingerprint_norm(title).alias("finger"), T.mix_type(title).alias("mix"), T.markdown_safe(title).alias("page"),
    )


@query(with_roles("tracks") + """
select uri, lower(replace(artists, '&', 'and')) as norm, array_to_string(list_sort(list_transform(string_split(artists, ','), lambda x: trim(lower(x)))), ', ') as sorted,
       trim(split_part(artists, ',', 1)) as first, array_to_string(list_sort(list_distinct(regexp_split_to_array(artists, '[,;&\\s]+'))), '|') as words,
       left(md5(artists || '||' || title), 8) as hash, split_part(uri, ':', 3) as id
from tracks""")
def str3_artist_rules(spark, sf):
    a = F.col("artists")
    return b.tracks(spark, sf).select(
        "uri", T.artist_norm(a).alias("norm"), T.sorted_artists(a).alias("sorted"), T.primary_artist(a).alias("first"),
        F.array_join(F.array_sort(T.artist_words(a)), "|").alias("words"), T.short_hash(F.concat(a, F.lit("||"), "title")).alias("hash"), T.uri_id(F.col("uri")).alias("id"),
    )


@query(with_roles("tracks") + """, n as (
    select uri, duration_ms, lower(title) as low from tracks)
select uri, duration_ms / 1000 + case when low like '%extended mix%' then 240 else 0 end - case when low like '%radio edit%' then 540 else 0 end as score,
       (duration_ms // 60000) || ':' || lpad(cast(duration_ms // 1000 % 60 as varchar), 2, '0') as label, duration_ms // 1000 as seconds,
       case when abs(duration_ms - 200000) <= 1000 then 1.25 when abs(duration_ms - 200000) <= 3000 then 1.2 when abs(duration_ms - 200000) <= 10000 then 1.15
            when abs(duration_ms - 200000) <= 30000 then 1.1 else 1.0 end :: double as boost from n""")
def num7_version_scores(spark, sf):
    ms = F.col("duration_ms")
    label = T.duration_label(ms)
    return b.tracks(spark, sf).select("uri", T.version_score(F.col("title"), ms).alias("score"), label.alias("label"), T.duration_seconds(label).alias("seconds"), T.duration_boost(F.lit(200000), ms).alias("boost"))


@query("""
select event_id, ts :: timestamp as iso, case when event_id % 4 = 3 then timestamp '2000-01-01' else date_trunc('second', ts) end as parsed from events""")
def dt1_parse_times(spark, sf):
    e = b.read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    said = (
        F.when(k == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
        .when(k == 2, F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("no time"))
    )
    return e.select("event_id", F.col("t").alias("iso"), T.parse_time(said, F.lit("2000-01-01 00:00:00").cast("timestamp")).alias("parsed"))


# --- linkage ------------------------------------------------------------------------------------------------

_TRACK_FORMS = """forms as (
    select uri, is_local, duration_ms, title as track_title, lower(title) as t_title, replace(lower(artists), '&', 'and') as t_artists,
           case when uri in (select uri from mappings where is_active) then 0.7 else 1.0 end :: double as penalty from tracks)"""


def _split_sql(title, base, version):
    """Base title and version note of a title, by the rules' own patterns."""
    kinds = [(p, f"regexp_matches({title}, '{p}')") for p in (T._BRACKETED, T._TRAILING)]
    cut = " ".join(f"when {test} then trim(regexp_replace({title}, '{p}', '', 'g'))" for p, test in kinds)
    note = " ".join(f"when {test} then trim(lower(regexp_extract({title}, '{p}', 1)))" for p, test in kinds)
    return f"case {cut} else {title} end as {base}, case {note} else '' end as {version}"


def _words_sql(c):
    return f"list_filter(list_distinct(regexp_split_to_array({c}, '[,;&\\s]+')), lambda w: w <> '')"


def _notes_sql(c):
    return f"list_filter(list_distinct(regexp_split_to_array({c}, '\\s+')), lambda w: list_contains({list(T.VERSION_WORDS)}, w))"


def _candidates_sql(threshold=0.6, k=8, odd=True):
    """All arms of linking: names meet tracks by a word of the artist or by none, stems meet all local titles."""
    files = "select file_path, duration_ms from inventory" + " union all select file_path, duration_ms from odd_files" * odd
    return with_roles("tracks", "mappings", "inventory", *["odd_files"] * odd) + f""", {_TRACK_FORMS}, names_ as (
    select *, regexp_extract(file_path, '([^/]*)$', 1) as name, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '') as stem from ({files})
), parts_ as (
    select file_path, duration_ms as file_ms, name, stem, case when contains(stem, ' - ') then replace(lower(trim(split_part(stem, ' - ', 1))), '&', 'and') else '' end as artist,
           lower(trim(case when contains(stem, ' - ') then substr(stem, instr(stem, ' - ') + 3) else stem end)) as title from names_
), files as (select *, {_split_sql('title', 'base', 'version')} from parts_),
regular as (select *, {_split_sql('t_title', 't_base', 't_version')} from forms where not is_local),
met as (
    select n.*, s.* from (select distinct artist, base, version from files) n join (select distinct t_artists, t_base, t_version from regular) s
    on n.artist = '' or list_has_any({_words_sql('n.artist')}, {_words_sql('s.t_artists')})
), bases as (select *, {indel_sql('base', 't_base')} as rb from (select distinct base, t_base from met)),
notes as (
    select *, {indel_sql('version', 't_version')} as rv, {_notes_sql('version')} as k1, {_notes_sql('t_version')} as k2 from (select distinct version, t_version from met)
), noted as (select version, t_version, case when len(k1) > 0 and len(k2) > 0 then greatest(rv, len(list_intersect(k1, k2)) / greatest(len(k1), len(k2))) else rv end as rn from notes),
singers as (
    select artist, t_artists, max(case when contains(t_artists, artist) then 1.0 else {indel_sql('artist', 'one')} end) as ra
    from (select artist, t_artists, trim(unnest(string_split(t_artists, ','))) as one from (select distinct artist, t_artists from met where artist <> '')) group by all
), rated as (
    select met.*, case when rb < 0.7 then rb * 0.5 when version <> '' and t_version <> '' then rb * 0.7 + rn * 0.3 when version <> '' or t_version <> '' then rb * 0.6 else rb end as rt, ra
    from met join bases using (base, t_base) join noted using (version, t_version) left join singers using (artist, t_artists)
), fuzzy as (
    select file_path, uri, least(1.0, case when artist = '' then rt * 0.9 else ra * 0.6 + rt * 0.4 end * penalty
        * case when abs(file_ms - duration_ms) <= 1000 then 1.25 when abs(file_ms - duration_ms) <= 3000 then 1.2 when abs(file_ms - duration_ms) <= 10000 then 1.15
               when abs(file_ms - duration_ms) <= 30000 then 1.1 else 1.0 end) as confidence
    from files join rated using (artist, base, version) join regular using (t_artists, t_base, t_version)
), locals_ as (select uri, track_title, t_title, penalty from forms where is_local),
likes as (
    select low, t_title, {indel_sql('low', 't_title')} as r from (select distinct lower(stem) as low from files), (select distinct t_title from locals_)
    where levenshtein(low, t_title) <= 0.2 * (len(low) + len(t_title)) + 0.001
), all_ as (
    select file_path, uri, confidence from fuzzy where confidence >= 0.2
    union all select file_path, uri, penalty from files join locals_ on track_title = stem or track_title = name
    union all select file_path, uri, 0.95 * penalty from files join locals_ on lower(stem) = t_title
    union all select file_path, uri, r * penalty from files join likes on lower(stem) = low join locals_ using (t_title) where r * penalty >= 0.8
), best_ as (select file_path, uri, max(round(confidence, 9)) as confidence from all_ group by all),
found as (
    select * from (select *, row_number() over (partition by file_path order by confidence desc, uri) as rank from best_ where confidence >= {threshold}) where rank <= {k})
"""


_CANDIDATES = _candidates_sql()


def _candidates(spark, sf, threshold=0.6, k=8):
    m = catalog.live_mappings(b.mappings(spark, sf))
    files = b.inventory(spark, sf).select("file_path", "duration_ms").unionByName(b.odd_files(spark, sf))
    return linkage.candidates(files, b.tracks(spark, sf), m, threshold, k)


@query(_CANDIDATES + "select file_path, uri, round(confidence, 6) as confidence, cast(rank as integer) as rank from found")
def comp6_link_records(spark, sf):
    return _candidates(spark, sf).select("file_path", "uri", F.round("confidence", 6).alias("confidence"), "rank")


@query(_CANDIDATES + "select file_path, uri, round(confidence, 6) as confidence from found where rank = 1 and confidence >= 0.75")
def win3_best_match(spark, sf):
    return _candidates(spark, sf).where("rank = 1 and confidence >= 0.75").select("file_path", "uri", F.round("confidence", 6).alias("confidence"))


@query(_CANDIDATES.replace("with ", "with recursive ", 1) + """, r as (
    select file_path, uri, round(confidence, 9) as confidence, false as won from found where confidence >= 0.75
    union all
    select * from (
        with m as (select *, row_number() over (partition by file_path order by confidence desc, uri) = 1 and row_number() over (partition by uri order by confidence desc, file_path) = 1 as best
                   from r where not won),
        w as (select * from m where best)
        select file_path, uri, confidence, true as won from w
        union all select file_path, uri, confidence, false from m where file_path not in (select file_path from w) and uri not in (select uri from w))
) select file_path, uri, round(confidence, 6) as confidence from r where won""")
def comp7_assign_one_to_one(spark, sf):
    out = linkage.assign_one_to_one(_candidates(spark, sf).where("confidence >= 0.75"))
    return out.select("file_path", "uri", F.round("confidence", 6).alias("confidence"))


@query(with_roles("tracks", "mappings") + f""", {_TRACK_FORMS}, q as (select distinct lower(p_name) as query from part), strings as (
    select distinct t_title, t_artists, t_artists || ' ' || t_title as both_ from forms
), hits as (
    select query, t_title, t_artists, both_, list_max([case when contains(t_title, query) then 0.95 end, case when contains(t_artists, query) then 0.95 end,
           case when contains(both_, query) then 0.9 end, case when tw > 0.5 then 0.8 * tw end, case when aw > 0.5 then 0.8 * aw end] :: double[]) as base from (
        select *, len(list_intersect(list_distinct(regexp_split_to_array(query, '\\s+')), regexp_split_to_array(t_title, '\\s+'))) / len(list_distinct(regexp_split_to_array(query, '\\s+'))) :: double as tw,
               len(list_intersect(list_distinct(regexp_split_to_array(query, '\\s+')), regexp_split_to_array(t_artists, '[,;&\\s]+'))) / len(list_distinct(regexp_split_to_array(query, '\\s+'))) :: double as aw
        from q, strings)
), scored as (
    select query, t_title, t_artists, greatest(base, {indel_sql('query', 't_title')} * 0.7, {indel_sql('query', 't_artists')} * 0.7, {indel_sql('query', 'both_')} * 0.6) as score
    from hits where base is not null
) select query, uri, round(confidence, 6) as confidence, cast(rank as integer) as rank from (
    select query, uri, score * penalty as confidence, row_number() over (partition by query order by round(score * penalty, 9) desc, uri) as rank
    from scored join forms using (t_title, t_artists) where score * penalty > 0.1) where rank <= 20""")
def comp8_search(spark, sf):
    q = b.read(spark, sf, "part").select(F.lower("p_name").alias("query")).distinct()
    out = linkage.search(b.tracks(spark, sf), catalog.live_mappings(b.mappings(spark, sf)), q, 20)
    return out.select("query", "uri", F.round("confidence", 6).alias("confidence"), "rank")


@query(with_roles("tracks", "mappings", "inventory") + """
select file_path, uri, gap_ms, cast(rank as integer) as rank from (
    select file_path, uri, abs(i.duration_ms - t.duration_ms) as gap_ms, row_number() over (partition by file_path order by abs(i.duration_ms - t.duration_ms), uri) as rank
    from inventory i join tracks t on abs(i.duration_ms - t.duration_ms) <= 60000) where rank <= 50""")
def jn17_nearest_durations(spark, sf):
    return linkage.nearest_durations(b.inventory(spark, sf), b.tracks(spark, sf))


_CONFLICTS = with_roles("mappings") + """, both_ as (
    select uri, file_path, max(case when is_active then 1.0 else (mapping_id % 100) / 100.0 end :: double) as confidence from mappings group by uri, file_path
), r as (select *, count(*) over (partition by uri) as n, row_number() over (partition by uri order by confidence desc, file_path) = 1 as recommended from both_),
s as (select uri, min(file_path) as choice from mappings where mapping_id % 17 = 0 group by uri),
c as (select r.*, coalesce(bool_or(file_path = choice) over (partition by r.uri), false) as valid, choice from r left join s on r.uri = s.uri where n > 1)
"""


@query(_CONFLICTS + """
select uri, file_path, confidence, recommended, case when valid then file_path = choice else recommended end as kept,
       case when not case when valid then file_path = choice else recommended end then case when valid then 'user_choice' else 'lower_confidence' end end as reason from c""")
def comp10_resolve_conflicts(spark, sf):
    m = b.mappings(spark, sf)
    proposed = m.where("not is_active").withColumn("confidence", (F.col("mapping_id") % 100) / 100.0)
    chosen = m.where("mapping_id % 17 = 0").groupBy("uri").agg(F.min("file_path").alias("file_path"))
    return linkage.resolve_conflicts(proposed, m.where("is_active"), chosen)


@query(with_roles("tracks", "mappings", "inventory") + """, proposed as (
    select file_path, 'item:track:' || (duration_ms // 200 % 3000) as uri from inventory union all select file_path, uri from mappings)
select p.file_path, p.uri, case when i.file_path is null then 'file_missing' when t.uri is null then 'uri_unknown' when now = p.uri then 'exists' when now is not null then 'conflict' else 'insert' end as status
from proposed p left join (select distinct file_path from inventory) i on i.file_path = p.file_path left join tracks t on t.uri = p.uri
left join (select file_path, arg_max(uri, mapping_id) as now from mappings where is_active group by file_path) m on m.file_path = p.file_path""")
def comp18_create_mappings(spark, sf):
    i, t, m = b.inventory(spark, sf), b.tracks(spark, sf), b.mappings(spark, sf)
    number = F.floor(F.col("duration_ms") / 200) % 3000
    drawn = i.select("file_path", F.concat(F.lit("item:track:"), number.cast("string")).alias("uri"))
    return linkage.create_mappings(drawn.unionByName(m.select("file_path", "uri")), i, t, m)


@query(with_roles("tracks").replace("with ", "with recursive ", 1) + f""", n as (select count(*) as suppliers from supplier),
v as (
    select distinct s_suppkey || '/' || p_brand || '/' || p_name as release_id, lower(p_brand || ' ' || p_name) as rt, p_name || ' (Extended Mix)' as version_title, (p_size % 60 + 5) * 60 + 30 as seconds
    from part, n, supplier where s_suppkey = p_partkey % suppliers
), t as (
    select uri, lower(title) as title, duration_ms, list_filter(regexp_split_to_array(lower(artists), '\\s+'), lambda w: len(w) > 2) as aw,
           list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: len(w) > 2) as tw from tracks
), met as (
    select distinct uri, release_id, title, lower(version_title) as low, version_title, seconds from t join v
    on list_has_any(tw, regexp_split_to_array(rt, '\\s+')) and len(list_filter(aw, lambda w: contains(rt, w))) > 0 and seconds > duration_ms / 1000 + 30
), {blocks_sql('blocks', 'met', 'low', 'title')}
select uri, release_id, version_title, cast(seconds as bigint) as seconds, 'Extended Mix' as mix from met join blocks using (low, title) where ratio > 0.7""")
def jn31_release_versions(spark, sf):
    s = b.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    suppliers = F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))  # one row
    p = b.read(spark, sf, "part").join(suppliers).withColumn("k", F.col("p_partkey") % F.col("n"))
    rows = p.join(s, "k").groupBy("k", "p_brand", "p_name").agg(F.collect_set(F.struct(F.concat("p_name", F.lit(" (Extended Mix)")).alias("title"), F.concat((F.col("p_size") % 60 + 5).cast("string"), F.lit(":30")).alias("duration"))).alias("tracklist"))
    releases = rows.select(F.concat_ws("/", F.col("k").cast("string"), "p_brand", "p_name").alias("release_id"), F.concat_ws(" ", "p_brand", "p_name").alias("release_title"), "tracklist")
    return linkage.release_versions(b.tracks(spark, sf), releases)


@query(_candidates_sql(0.0, 10, odd=False) + """, h as (
    select file_path, instr(lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')), 'widget') as place from inventory
), o as (select file_path, arg_max(uri, mapping_id) as uri from mappings where is_active group by file_path)
select h.file_path, o.uri, cast(place as integer) as place, round(case when o.uri is null then 0 when t.uri is null then 0.5 else coalesce(f.confidence, 0.4) end :: double, 6) as confidence
from h left join o on o.file_path = h.file_path left join tracks t on t.uri = o.uri left join found f on f.file_path = h.file_path and f.uri = o.uri where place > 0""")
def comp22_file_search(spark, sf):
    out = linkage.file_search(b.inventory(spark, sf), b.tracks(spark, sf), b.mappings(spark, sf), "Widget")
    return out.withColumn("confidence", F.round("confidence", 6))


@query(_CANDIDATES + """, g as (select file_path, max(confidence) as best from found group by file_path)
select count(*) as files, count(*) filter (where best >= 0.75) as sure, round(avg(best), 6) as mean from g""")
def agg19_match_quality(spark, sf):
    best = _candidates(spark, sf).groupBy("file_path").agg(F.max("confidence").alias("best"))
    return best.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("best") >= 0.75).alias("sure"), F.round(F.avg("best"), 6).alias("mean"))


# --- duplicates ---------------------------------------------------------------------------------------------

_GROUPS = with_roles("tracks", "pairs") + """, f as (
    select *, lower(title) as ct, array_to_string(list_sort(list_transform(string_split(artists, ','), lambda x: trim(lower(x)))), ', ') as ca from tracks
), g as (
    select *, min(uri) over w as leader, count(*) over w as n, min(duration_ms) over w = max(duration_ms) over w as manual from f window w as (partition by ct, ca)
), m as (
    select left(md5(leader), 8) as group_id, uri, leader, manual, n, case when manual then row_number() over (partition by leader order by uri)
           else row_number() over (partition by leader order by duration_ms desc, is_local, track_id is null, length(coalesce(album, '')) desc, uri) end = 1 as primary_ from g where n > 1)
"""


def _groups(spark, sf):
    return duplicates.duplicate_groups(b.tracks(spark, sf))


@query(_GROUPS + 'select group_id, uri, primary_ as "primary", manual, n from m')
def comp9_duplicate_groups(spark, sf):
    return _groups(spark, sf).drop("leader")


@query(_GROUPS + """select count(distinct leader) as groups, count(distinct case when manual then leader end) as manual_groups, count(*) as rows,
count(*) filter (where not primary_) as removals from m""")
def agg18_duplicate_report(spark, sf):
    return duplicates.duplicate_report(_groups(spark, sf))


@query(_GROUPS + """, s as (select a.uri, b.uri as survivor from m a join m b on a.leader = b.leader and b.primary_)
select distinct coalesce(survivor, p.uri) as uri, playlist_id from pairs p left join s on s.uri = p.uri""")
def comp11_merged_memberships(spark, sf):
    return duplicates.merge_duplicates(b.tracks(spark, sf), b.pairs(spark, sf), duplicates.survivors(_groups(spark, sf)))[1]


@query(_GROUPS + "select uri, title from tracks where uri not in (select uri from m where not primary_)")
def comp11_remaining_tracks(spark, sf):
    return duplicates.merge_duplicates(b.tracks(spark, sf), b.pairs(spark, sf), duplicates.survivors(_groups(spark, sf)))[0].select("uri", "title")


_NAMES = """names as (
    select uri, lower(trim(split_part(artists, ',', 1))) as artist, trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as name from tracks)"""


@query(with_roles("tracks", "pairs") + f""", {_NAMES}, d as (select distinct artist, name from names),
r as (select x.artist, x.name as a, y.name as b, {indel_sql('x.name', 'y.name')} as ratio from d x join d y on x.artist = y.artist)
select p.playlist_id, p.uri as a, q.uri as b, round(ratio, 6) as ratio from pairs p join names m on m.uri = p.uri join pairs q on q.playlist_id = p.playlist_id and p.uri < q.uri
join names n on n.uri = q.uri and n.artist = m.artist join r on r.artist = m.artist and r.a = m.name and r.b = n.name where ratio >= 0.85""")
def comp9b_version_pairs(spark, sf):
    members = b.pairs(spark, sf).join(b.tracks(spark, sf), "uri")
    out = duplicates.version_pairs(members)
    return out.select("playlist_id", "a", "b", F.round("ratio", 6).alias("ratio"))


@query(with_roles("tracks", "pairs") + """, m as (
    select playlist_id, t.uri, lower(trim(split_part(artists, ',', 1))) as artist, duration_ms / 1000 + case when lower(title) like '%extended mix%' then 240 else 0 end
           - case when lower(title) like '%radio edit%' then 540 else 0 end as score from pairs p join tracks t on t.uri = p.uri)
select playlist_id, uri, score, cast(row_number() over (partition by playlist_id, artist order by score desc, uri) as integer) as rank from m""")
def win5_rank_versions(spark, sf):
    members = b.pairs(spark, sf).join(b.tracks(spark, sf), "uri").withColumn("artist", F.lower(T.primary_artist(F.col("artists"))))
    return duplicates.rank_versions(members, ["playlist_id", "artist"]).select("playlist_id", "uri", "score", "rank")


@query(with_roles("mappings") + """, spare as (select uri from mappings where is_active group by uri having count(*) > 1)
select mapping_id, file_path, uri from mappings where not (mapping_id % 4 = 1 and uri in (select uri from spare))""")
def comp23_remove_spare_mapping(spark, sf):
    m = b.mappings(spark, sf)
    return duplicates.remove_spare_mapping(m, m.where("mapping_id % 4 = 1").select("file_path", "uri")).select("mapping_id", "file_path", "uri")


@query(with_roles("tracks", "mappings") + """
select m.uri, artists || ' - ' || title as label, n from (select uri, count(*) as n from mappings where is_active group by uri having count(*) > 1) m left join tracks t on t.uri = m.uri""")
def comp27_duplicate_files(spark, sf):
    t = b.tracks(spark, sf).select("uri", T.display_name(F.col("artists"), F.col("title")).alias("label"))
    return duplicates.files_per_uri(b.mappings(spark, sf)).join(t, "uri", "left").select("uri", "label", "n")


# --- playlist files -----------------------------------------------------------------------------------------

_ENTRIES = with_roles("playlists", "pairs", "tracks", "mappings", "inventory") + """, latest as (
    select uri, arg_max(file_path, mapping_id) as path from mappings where is_active group by uri
), e as (
    select playlist_id, row_number() over (partition by playlist_id order by p.uri) as pos, p.uri, cast(duration_ms // 1000 as integer) as duration, artists || ' - ' || title as info, path
    from pairs p join latest l on l.uri = p.uri join tracks t on t.uri = p.uri where path in (select file_path from inventory))
"""


def _entries(spark, sf):
    return playlists.entries(b.pairs(spark, sf), b.tracks(spark, sf), b.mappings(spark, sf), b.inventory(spark, sf))


def _parsed(spark, sf):
    """The playlists' lines, parsed again as rows."""
    return playlists.parse_lines(playlists.m3u_lines(_entries(spark, sf)).withColumnRenamed("playlist_id", "file"))


@query(_ENTRIES + """select playlist_id, md5('#EXTM3U' || chr(10) || string_agg('#EXTINF:' || duration || ',' || info || chr(10) || path, chr(10) order by pos)) as content, count(*) as n
from e group by playlist_id""")
def snk7_playlist_texts(spark, sf):
    listed = _entries(spark, sf)
    texts = playlists.m3u_text(playlists.m3u_lines(listed)).withColumn("content", F.md5("content"))
    return texts.join(listed.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n")), "playlist_id")


@query(_ENTRIES + """select playlist_id as file, cast(pos as integer) as pos, duration, info, split_part(info, ' - ', 1) as artist, substr(info, instr(info, ' - ') + 3) as title, path from e""")
def comp21_parse_m3u(spark, sf):
    return _parsed(spark, sf)


@query(_ENTRIES + """select e.playlist_id as file, path, m.uri from e left join (
    select file_path, arg_max(uri, mapping_id) as uri from mappings where is_active group by file_path) m on m.file_path = e.path""")
def jn19_entry_uris(spark, sf):
    return playlists.entry_uris(_parsed(spark, sf), b.mappings(spark, sf)).select("file", "path", "uri")


@query(_ENTRIES + """select i.file_path as path, coalesce(string_agg(distinct playlist_id, '|' order by playlist_id), '') as files from inventory i left join e on e.path = i.file_path group by i.file_path""")
def jn20_playlists_of_paths(spark, sf):
    out = playlists.playlists_of_paths(_parsed(spark, sf), b.inventory(spark, sf).select(F.col("file_path").alias("path")))
    return out.select("path", F.array_join("files", "|").alias("files"))


@query(_ENTRIES + """, w as (select distinct p_name as wanted from part)
select wanted, count(distinct playlist_id) as n_files, count(playlist_id) as n_entries from w left join e on contains(lower(info), lower(wanted)) group by wanted""")
def jn21_playlists_of_titles(spark, sf):
    return playlists.playlists_of_titles(_parsed(spark, sf), b.read(spark, sf, "part").select(F.col("p_name").alias("wanted")))


@query(_ENTRIES + """select p.playlist_id, coalesce(m, 0) as members, coalesce(a, 0) as added from playlists p
left join (select playlist_id, count(*) as m from pairs group by playlist_id) x on x.playlist_id = p.playlist_id
left join (select playlist_id, count(*) as a from e group by playlist_id) y on y.playlist_id = p.playlist_id""")
def comp26_generation_counts(spark, sf):
    return playlists.m3u_counts(b.playlists(spark, sf), b.pairs(spark, sf), _entries(spark, sf))


_CHECKED = with_roles("playlists", "pairs", "incoming_pairs", "tracks", "mappings", "inventory") + """, state as (
    select uri, max(case when file_path in (select file_path from inventory) then 1 end) as local from mappings where is_active group by uri
), latest as (select uri, arg_max(file_path, mapping_id) as path from mappings where is_active group by uri),
owner as (select file_path, arg_max(uri, mapping_id) as uri from mappings where is_active group by file_path),
listed as (select distinct p.playlist_id, o.uri from pairs p join latest l on l.uri = p.uri join owner o on o.file_path = l.path where l.path in (select file_path from inventory)),
b_ as (
    select coalesce(i.playlist_id, l.playlist_id) as playlist_id, i.uri as member, l.uri as listed, s.local, s.uri as mapped
    from incoming_pairs i left join state s on s.uri = i.uri full join listed l on l.playlist_id = i.playlist_id and l.uri = i.uri
), c as (
    select playlist_id, count(member) as catalog, count(*) filter (where local = 1) as local, count(listed) as listed, count(*) filter (where local = 1 and listed is null) as missing,
           count(*) filter (where listed is not null and member is null) as unexpected, count(*) filter (where member is not null and mapped is not null and local is null) as file_missing,
           count(*) filter (where member is not null and mapped is null) as no_mapping from b_ group by playlist_id
), x as (
    select p.playlist_id, name, coalesce(catalog, 0) as catalog, coalesce(local, 0) as local, coalesce(listed, 0) as listed, coalesce(missing, 0) as missing, coalesce(unexpected, 0) as unexpected,
           coalesce(file_missing, 0) as file_missing, coalesce(no_mapping, 0) as no_mapping, p.playlist_id in (select playlist_id from listed) as has_file
    from playlists p left join c on c.playlist_id = p.playlist_id
), v as (select *, listed - local as discrepancy, missing + unexpected as identified, abs(listed - local) - missing - unexpected as unidentified,
                not has_file or missing + unexpected > 0 or listed <> local as needs_update from x)
"""


def _checked(spark, sf):
    return playlists.validate_playlists(b.playlists(spark, sf), b.incoming_pairs(spark, sf), b.mappings(spark, sf), b.inventory(spark, sf), _parsed(spark, sf))


@query(_CHECKED + "select * from v")
def comp15_validate_playlists(spark, sf):
    return playlists.by_severity(_checked(spark, sf))


@query(_CHECKED + "select count(*) as total, count(*) filter (where needs_update) as needing_update, count(*) filter (where not has_file) as missing_files from v")
def agg17_validation_summary(spark, sf):
    return playlists.validation_summary(_checked(spark, sf))


@query(with_roles("playlists", "pairs", "tracks", "mappings", "inventory", "ratings") + _ENTRIES[_ENTRIES.index(", latest as"):].rstrip() + """,
first_ as (select *, row_number() over (partition by path order by playlist_id, pos) as k from e),
owner as (select file_path, arg_max(uri, mapping_id) as uri from mappings where is_active group by file_path)
select row_number() over (order by playlist_id, pos) as track_no, path, split_part(info, ' - ', 1) || '_' || substr(info, instr(info, ' - ') + 3) || '_' || left(md5(path), 8) as key,
       split_part(info, ' - ', 1) as artist, substr(info, instr(info, ' - ') + 3) as title, duration, 'file://localhost/' || ltrim(path, '/') as location, 'MP3 File' as kind, o.uri,
       least(cast(floor(rating) as bigint) * 51, 255) as stars, energy
from first_ f left join owner o on o.file_path = f.path left join ratings r on r.uri = o.uri where k = 1""")
def comp14_collection(spark, sf):
    return playlists.collection_tracks(_parsed(spark, sf), b.mappings(spark, sf), b.ratings(spark, sf))


@query(_ENTRIES + "select playlist_id as file, count(distinct path) as n from e group by playlist_id")
def agg21_distinct_entries(spark, sf):
    parsed = _parsed(spark, sf)
    all_ = playlists.collection_entries(parsed, playlists.collection_tracks(parsed, b.mappings(spark, sf), b.ratings(spark, sf)))
    return all_.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(with_roles("pairs") + """
select p.uri, p.playlist_id, coalesce(string_agg(q.playlist_id, '|' order by q.playlist_id), '') as others from pairs p left join pairs q on q.uri = p.uri and q.playlist_id <> p.playlist_id group by p.uri, p.playlist_id""")
def snk12_also_in(spark, sf):
    return playlists.also_in(b.pairs(spark, sf)).select("uri", "playlist_id", F.array_join("others", "|").alias("others"))


@query(with_roles("pairs", "playlists", "tracks") + """, o as (
    select p.uri, p.playlist_id, string_agg(q.playlist_id, ', ' order by q.playlist_id) as others from pairs p join pairs q on q.uri = p.uri and q.playlist_id <> p.playlist_id group by p.uri, p.playlist_id
), l as (
    select name, artists, title, '- ' || artists || ' - ' || title || coalesce(' (also in ' || others || ')', '') as line
    from pairs p join playlists using (playlist_id) join tracks using (uri) left join o on o.uri = p.uri and o.playlist_id = p.playlist_id)
select regexp_replace(name, '[^\\w ]', '', 'g') as name, '# ' || name || chr(10) || chr(10) || string_agg(line, chr(10) order by artists, title, line) as content from l group by l.name""")
def snk12_markdown_pages(spark, sf):
    named = b.pairs(spark, sf).join(b.playlists(spark, sf).select("playlist_id", "name"), "playlist_id").join(b.tracks(spark, sf).select("uri", "artists", "title"), "uri")
    return exports.markdown_pages(named, playlists.also_in(b.pairs(spark, sf)))


# --- folders ------------------------------------------------------------------------------------------------

_FOLDERS = with_roles("playlists", "incoming_playlists") + """, now_ as (
    select name, 'f' || (ltrim(token, 'v')) || case when playlist_id like '%5' then '' else '/g' || right(playlist_id, 1) end as folder, cast(length(name) as integer) as pos from playlists
), next_ as (select name, case when playlist_id like '%7' then '' else 'f' || ltrim(token, 'v') || '/h' end as folder from incoming_playlists)
"""


def _now(spark, sf):
    p = b.playlists(spark, sf)
    deep = F.when(F.endswith("playlist_id", F.lit("5")), F.lit("")).otherwise(F.concat(F.lit("/g"), F.right("playlist_id", F.lit(1))))
    return p.select("name", F.concat(F.lit("f"), F.ltrim("token", F.lit("v")), deep).alias("folder"), F.length("name").alias("pos"))


def _next(spark, sf):
    p = b.incoming_playlists(spark, sf)
    return p.select("name", F.when(F.endswith("playlist_id", F.lit("7")), F.lit("")).otherwise(F.concat(F.lit("f"), F.ltrim("token", F.lit("v")), F.lit("/h"))).alias("folder"))


@query(_FOLDERS + """select coalesce(a.name, b.name) as name, case when a.name is null then 'create' when b.name is null then 'remove' when a.folder <> b.folder then 'move' else 'keep' end as action,
a.folder as from_folder, b.folder as to_folder from now_ a full join next_ b on a.name = b.name""")
def comp12_plan_moves(spark, sf):
    return hierarchy.plan_moves(_now(spark, sf), _next(spark, sf))


@query(_FOLDERS + """, a as (select folder from now_ union select split_part(folder, '/', 1) from now_), b_ as (select folder from next_ where folder <> '' union select split_part(folder, '/', 1) from next_ where folder <> '')
select folder, 'create' as action from (select * from b_ except select * from a) union all select folder, 'remove' from (select * from a except select * from b_)""")
def comp12_plan_folders(spark, sf):
    return hierarchy.plan_folders(_now(spark, sf), _next(spark, sf))


@query(_FOLDERS + """, m as (
    select folder, name, pos from now_ where name in (select name from next_) union all select distinct '', name, cast(null as integer) from next_ where name not in (select name from now_))
select folder, name, cast(row_number() over (partition by folder order by pos nulls last, name) as integer) as pos from m""")
def comp13_merge_structure(spark, sf):
    return hierarchy.merge_structure(_now(spark, sf), _next(spark, sf))


@query(_FOLDERS + """, a as (select folder from now_ union select split_part(folder, '/', 1) from now_ union select '')
select folder, (select count(*) from a c where c.folder <> '' and case when contains(c.folder, '/') then split_part(c.folder, '/', 1) else '' end = a.folder) as folders,
       (select count(distinct name) from now_ n where n.folder = a.folder) as playlists from a""")
def agg20_child_counts(spark, sf):
    return hierarchy.child_counts(_now(spark, sf))


@query(_FOLDERS + "select distinct name, 'file' as kind from now_ where name not in (select name from incoming_playlists) union all select distinct name, 'entry' from next_ where name not in (select name from incoming_playlists)")
def jn28_orphaned(spark, sf):
    return hierarchy.orphaned(_now(spark, sf), b.incoming_playlists(spark, sf), _next(spark, sf))


@query(_FOLDERS + """select n.name, coalesce(min(a.folder), min(c.folder), '') as folder, case when min(a.folder) is not null then 'exact' when min(c.folder) is not null then 'lower' else 'root' end as rule
from (select distinct case when playlist_id like '%3' then upper(name) else name end as name from incoming_playlists) n left join now_ a on a.name = n.name left join now_ c on lower(c.name) = lower(n.name) group by n.name""")
def jn30_folder_of_playlists(spark, sf):
    names = b.incoming_playlists(spark, sf).select(F.when(F.endswith("playlist_id", F.lit("3")), F.upper("name")).otherwise(F.col("name")).alias("name"))
    return hierarchy.folder_of_playlists(names, _now(spark, sf))


@query(_FOLDERS + """select count(*) filter (where b.name is null) as only_a, count(*) filter (where a.name is null) as only_b, count(*) filter (where a.name is null or b.name is null) <= 2 as same
from (select distinct name from now_) a full join (select distinct name from next_) b on a.name = b.name""")
def set6_same_within(spark, sf):
    return hierarchy.same_within(_now(spark, sf), _next(spark, sf), "name")


@query(_FOLDERS + "select folder, name, cast(row_number() over (partition by folder order by pos, name) - 1 as integer) as pos from now_")
def snk13_structure_round_trip(spark, sf):
    return hierarchy.structure_rows(hierarchy.structure_json(_now(spark, sf)))


@query(with_roles("pairs") + "," + _FOLDERS[len("with "):].rstrip() + """, d as (select *, case when token = 'v3' then 'The Set list' when token = 'v4' then 'reset' end as about from playlists)
select playlist_id, d.name, folder, (select count(*) from pairs m where m.playlist_id = d.playlist_id) as n from d left join now_ on now_.name = d.name
where not (contains(lower(d.name), '00007') or d.name = 'Supplier#000000003' or coalesce(regexp_matches(lower(about), '\\bset\\b'), false)) and upper(d.name) <> 'MASTER'""")
def comp25_overview(spark, sf):
    about = F.when(F.col("token") == "v3", "The Set list").when(F.col("token") == "v4", "reset")
    p = b.playlists(spark, sf).withColumn("about", about)
    out = catalog.excluded(F.col("name"), F.col("playlist_id"), F.col("about"), ["00007"], ["Supplier#000000003"], [], ["Set"])
    return catalog.overview(p, b.pairs(spark, sf), _now(spark, sf), out)


# --- reports ------------------------------------------------------------------------------------------------


@query(with_roles("inventory") + """
select file_path, artist, title, duration_ms from (select *, split_part(stem, ' - ', 1) as artist, substr(stem, instr(stem, ' - ') + 3) as title from (
    select file_path, duration_ms, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '') as stem from inventory)) where duration_ms < 300000 order by duration_ms, file_path limit 100""")
def flt14_short_items(spark, sf):
    return validate.short_items(b.inventory(spark, sf)).orderBy("duration_ms", "file_path").limit(100)


@query(with_roles("tracks", "mappings", "inventory") + """
select i.file_path, i.duration_ms, max(added_at) as added_at from inventory i left join mappings m on m.file_path = i.file_path and m.is_active left join tracks t on t.uri = m.uri
where i.duration_ms < 300000 group by i.file_path, i.duration_ms""")
def flt15_short_with_dates(spark, sf):
    out = validate.short_tracks_with_dates(b.inventory(spark, sf), b.mappings(spark, sf), b.tracks(spark, sf))
    return out.select("file_path", "duration_ms", "added_at").orderBy(F.desc_nulls_last("added_at"), "file_path")


_MISMATCH = """mismatch as (select * from (select m.file_path, m.uri, round(1 - levenshtein(lower(regexp_replace(regexp_extract(m.file_path, '([^/]*)$', 1), '\\.[^.]+$', '')), lower(artists || ' - ' || title))
    / greatest(length(regexp_replace(regexp_extract(m.file_path, '([^/]*)$', 1), '\\.[^.]+$', '')), length(artists || ' - ' || title)) :: double, 6) as similarity
    from mappings m join tracks t on t.uri = m.uri where is_active) where similarity < 0.7)"""


@query(with_roles("tracks", "mappings") + f", {_MISMATCH} select * from mismatch")
def jn27_mapping_mismatches(spark, sf):
    return validate.mapping_mismatches(b.mappings(spark, sf), b.tracks(spark, sf)).orderBy("similarity", "file_path")


@query(with_roles("tracks", "mappings", "inventory") + f""", {_MISMATCH}
select (select count(*) from inventory) as files, (select count(*) from mappings where is_active) as mappings,
       (select count(*) from inventory where lower(file_path) not in (select lower(file_path) from mappings where is_active)) as unmapped, (select count(*) from mismatch) as mismatched,
       (select count(*) from (select uri from mappings where is_active and file_path in (select file_path from inventory) group by uri having count(*) > 1)) as duplicated""")
def comp16_mapping_summary(spark, sf):
    return validate.mapping_summary(b.mappings(spark, sf), b.inventory(spark, sf), b.tracks(spark, sf))


@query(with_roles("tracks", "inventory") + """, names as (
    select lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]+$', '')) as name, min(file_path) as file_path from inventory where file_path not like '%.txt' group by 1)
select 'unknown_id' as kind, embedded_track_id as key, file_path from inventory where embedded_track_id <> '' and embedded_track_id not in (select track_id from tracks where track_id is not null)
union all select 'no_id', null, file_path from inventory where embedded_track_id = ''
union all select 'no_file', track_id, n.file_path from tracks left join names n on n.name = lower(artists || ' - ' || title)
where track_id is not null and track_id not in (select embedded_track_id from inventory)""")
def comp17_catalog_ids(spark, sf):
    return validate.catalog_ids(b.inventory(spark, sf), b.tracks(spark, sf))


@query(with_roles("tracks", "ratings") + """
select count(*) as rated, count(*) filter (where r.uri like 'item:track:%') as track_uris, count(*) filter (where r.uri like 'item:local:%') as local_uris, count(t.uri) as in_catalog,
       round(100.0::double * count(t.uri) / greatest(count(*), 1), 4) as coverage from ratings r left join tracks t on t.uri = r.uri""")
def agg14_rating_coverage(spark, sf):
    return validate.rating_coverage(b.ratings(spark, sf), b.tracks(spark, sf))


@query(with_roles("tracks", "ratings", "mappings", "inventory") + """
select r.uri, rating, title, case when title is null then 'not_in_catalog' when r.uri not in (select uri from mappings where is_active) then 'no_mapping' else 'not_in_playlists' end as reason
from ratings r left join tracks t on t.uri = r.uri where r.uri not in (select m.uri from mappings m where is_active and file_path in (select file_path from inventory))""")
def jn23_unapplied_ratings(spark, sf):
    m = b.mappings(spark, sf)
    applied = catalog.live_mappings(m).join(b.inventory(spark, sf).select("file_path"), "file_path", "left_semi")
    return validate.unapplied_ratings(b.ratings(spark, sf), applied, b.tracks(spark, sf), m)


@query(with_roles("inventory") + """
select e.ext, count(i.file_path) as n from (select unnest(['mp3', 'flac', 'aiff', 'wav', 'm4a', 'aac', 'ogg', 'wma']) as ext) e
left join inventory i on lower(regexp_extract(i.file_path, '\\.([^.]+)$', 1)) = e.ext group by e.ext""")
def agg15_extension_counts(spark, sf):
    return validate.extension_counts(b.inventory(spark, sf))


# --- streams ------------------------------------------------------------------------------------------------


@query("""
select user_id as playlist_id, day as ts, n, before from (select user_id, day, n, coalesce(lag(n) over (partition by user_id order by day), 0) as before from (
    select user_id, date_trunc('day', ts) :: timestamp as day, count(*) as n from events group by 1, 2)) where n <> before""")
def stm1_count_changes(spark, sf):
    e = b.read(spark, sf, "events").groupBy(F.col("user_id").alias("playlist_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return gates.count_changes(e)


@query(registry.SQL["stm1_count_changes"])
def stm1_streamed_counts(spark, sf):
    """The same history as a stream in three deliveries, each by a query of its own that goes on from the checkpoint; the first comes twice."""
    to = folder(spark, "counts")
    e = b.read(spark, sf, "events").groupBy(F.col("user_id").alias("playlist_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    history = staged(e, "history")
    low, high = history.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    third = F.least(F.floor((F.unix_micros("ts") - low) * 3 / max(1, high - low)), F.lit(2))
    for parts in ([0], [1, 0], [2]):
        history.where(third.isin(parts)).write.mode("append").parquet(f"{to}/in")
        observed = spark.readStream.schema(history.schema).parquet(f"{to}/in")

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}")

        run = gates.stream_count_changes(observed).writeStream.foreachBatch(keep).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(f"{to}/out").drop("batch")


@query("select date_trunc('day', ts) :: timestamp as start, event_type, count(*) as n from events group by 1, 2")
def stm_windowed_counts(spark, sf):
    """The same windows as a stream: the files' rows go through a watermark to a sink in complete mode."""
    to = folder(spark, "stream")
    schema = b.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = gates.windowed_counts(events, "ts", "event_type")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{to}/out")

    run = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{to}/out")


@query(with_roles("playlists", "incoming_playlists") + """
select i.playlist_id, i.token from incoming_playlists i left join playlists p on p.playlist_id = i.playlist_id where p.playlist_id is null or p.token <> i.token""")
def stm2_token_gate(spark, sf):
    """Snapshots as a stream, delivered twice: each changed parent is handled once."""
    from concordat.streaming.state import TokenStore

    to = folder(spark, "gate")
    snapshots = b.incoming_playlists(spark, sf).select("playlist_id", "token", F.lit("2024-01-01").alias("ts"))
    for k in range(2):
        snapshots.write.mode("append").parquet(f"{to}/snapshots")
    store = TokenStore(b.playlists(spark, sf).select("playlist_id", "token"), f"{to}/tokens")

    def handle(rows, number):
        rows.select("playlist_id", "token").write.mode("append").parquet(f"{to}/handled")

    stream = spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/snapshots")
    gates.run_gated(stream, store.read, handle, store.write, f"{to}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{to}/handled")
