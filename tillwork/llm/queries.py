"""One query per operator over its whole table, and reference SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.llm import conversation_repair, html_blocks, langid, licenses, mixing, periodic_runs, pieces, quality_crf, sharding, warc_revisits
from tillwork.llm.chunk_dedup import exact_duplicates
from tillwork.llm.common import crc32_fold
from tillwork.llm.jaccard_join import jaccard_components
from tillwork.llm.winnowing import contamination

QUERIES, ORACLES = {}, {}
# Vocabulary of the installed public tokenizers; on a cluster, a path that every worker has.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
    from (select doc_id, coalesce(text, '') as body,
                 max(doc_id) over (partition by coalesce(text, '')) as keep_id,
                 count(*) over (partition by coalesce(text, '')) as group_size
          from documents)""")
def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
    with recursive w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') as words
        from documents),
    sh as (
        select distinct doc_id, array_to_string(words[i:i + 3], ' ') as gram
        from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) as i from w where len(words) > 0)),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    shared as (
        select a.doc_id as a, b.doc_id as b, count(*) as common
        from sh a join sh b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
    links as (
        select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b
        where 100 * common >= 85 * (x.n + y.n - common)),
    steps as (select a, b from links union all select b, a from links),
    reach as (
        select doc_id as start, doc_id as seen from w
        union
        select start, b from reach join steps on a = seen),
    names as (select start, min(seen) as component_id from reach group by start)
    select w.doc_id, coalesce(n, 0) as n_shingles, component_id
    from w left join n using (doc_id) join names on start = w.doc_id""")
def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


@query(r"""
    with w as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
        from documents),
    b as (
        select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
        from benchmark),
    item_windows as (
        select distinct item_id, least(len(words), 10) as n, array_to_string(words[j:j + least(len(words), 10) - 1], ' ') as body
        from (select *, unnest(generate_series(1, greatest(len(words) - 9, 1))) as j from b where len(words) > 0)),
    sizes as (select distinct n from item_windows),
    doc_windows as (
        select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as body
        from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from w cross join sizes where len(words) >= n)),
    found as (select doc_id, i, n, item_id from doc_windows join item_windows using (n, body)),
    hit as (
        select doc_id, count(distinct word) as n_hit
        from (select doc_id, unnest(generate_series(i, i + n - 1)) as word from found) group by doc_id),
    names as (
        select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
    select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
    from w left join hit using (doc_id) left join names using (doc_id)""")
def op3_benchmark_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op1_quality_classifier(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_fold(F.col("doc_id"), 5)
    model = quality_crf.train(docs, table(spark, sf_dir, "labels").where(fold != 0))
    return quality_crf.score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score",
                                                 (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op9_language_id(spark, sf_dir):
    docs, fold = table(spark, sf_dir, "documents"), crc32_fold(F.col("doc_id"), 3)
    model = langid.train(docs.where(fold != 1))
    return langid.identify(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


@query()
def op7_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, PIECES).select(
        "doc_id", "n_pieces", "score", F.sha2(F.col("pieces"), 256).alias("pieces_sha256"),
        F.transform("alternatives", lambda a: a["score"]).alias("other_scores"),
        F.sha2(F.to_json("alternatives"), 256).alias("alternatives_sha256"), "pieces")
    kept = ["doc_id", "n_pieces", "score", "pieces_sha256", "other_scores", "alternatives_sha256"]
    return pieces.decode(encoded, PIECES, kept, into="decoded").withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


@query()
def op2_html_extraction(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def _canonical_sql(text):
    """The canonical form of a licence text in DuckDB."""
    words = (f"regexp_split_to_array(regexp_replace(lower(coalesce({text}, '')), "
             r"'(?m)^[ \t]*(copyright|©|\(c\)|all rights reserved)[^\n]*$', '', 'g'), '[^\p{L}\p{N}]+')")
    table = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS.items()) + "}"
    out = f"' ' || array_to_string([coalesce(({table})[w], w) for w in {words} if w <> ''], ' ') || ' '"
    for pair, word in licenses.COMPOUNDS.items():
        out = f"replace({out}, ' {pair} ', ' {word} ')"
    return f"sha256(trim({out}))"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in licenses.KNOWN)


@query(f"""
    with known as (
        select {_canonical_sql("body")} as digest, min(license) as license from (values {_KNOWN_SQL}) as k(license, body) group by 1),
    whole as (select doc_id, {_canonical_sql("text")} as digest from documents),
    lines as (
        select doc_id, {_canonical_sql("line")} as digest
        from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)),
    notices as (
        select doc_id, string_agg(distinct license, ',' order by license) as notices from lines join known using (digest) group by doc_id)
    select doc_id, digest, license, coalesce(notices, '') as notices
    from whole left join known using (digest) left join notices using (doc_id)""")
def op4_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


SHARDS = [f"shard-{i:02d}" for i in range(16)]


@query(f"""
    with recursive shards as (
        select name, cast('0x' || substr(md5('offset|' || name), 1, 8) as bigint) % {sharding.DEFAULT_SLOTS} as start,
               cast('0x' || substr(md5('step|' || name), 1, 8) as bigint) % {sharding.DEFAULT_SLOTS - 1} + 1 as step,
               row_number() over (order by name) - 1 as turn
        from (select 'shard-' || lpad(cast(i as varchar), 2, '0') as name from range({len(SHARDS)}) as r(i))),
    fill as (
        select 0 as t, cast([] as bigint[]) as taken
        union all
        select t + 1, list_append(taken, (
            select (start + k * step) % {sharding.DEFAULT_SLOTS}
            from shards, range({sharding.DEFAULT_SLOTS}) as places(k)
            where turn = t % {len(SHARDS)} and not list_contains(taken, (start + k * step) % {sharding.DEFAULT_SLOTS})
            order by k limit 1))
        from fill where t < {sharding.DEFAULT_SLOTS}),
    slots as (
        select unnest(taken) as slot, (generate_subscripts(taken, 1) - 1) % {len(SHARDS)} as turn
        from fill where t = {sharding.DEFAULT_SLOTS}),
    keyed as (
        select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % {sharding.DEFAULT_SLOTS} as slot
        from documents)
    select doc_id, cast(slot as integer) as slot, name as shard from keyed join slots using (slot) join shards using (turn)""")
def op6_sharding(spark, sf_dir):
    names = spark.createDataFrame([(s,) for s in SHARDS], "shard string")
    placement = sharding.lookup_table(names)
    return sharding.assign(table(spark, sf_dir, "documents"), placement, "doc_id", keep=("doc_id",))


def captures(pages):
    """Archive records made of pages: a full response of each page and an answer of 304 to a later
    request, some with a weak tag, some with a date only, some after a change, some too early."""
    tag, day, number = F.md5(F.coalesce("html", F.lit(""))), F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string")), F.col("page_id")
    full = pages.select((number * 2).alias("record_id"), "url", number.alias("at"), F.lit(200).alias("status"), F.create_map(
        F.lit("etag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.length("html").cast("string")).alias("headers"))
    own = (F.when(number % 7 == 0, F.create_map(F.lit("etag"), F.lit('"other"')))
           .when(number % 3 == 0, F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"'))))
           .when(number % 3 == 1, F.create_map(F.lit("last-modified"), day))
           .otherwise(F.create_map(F.lit("last-modified"), F.lit("day 3"))))
    common = F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-type"), F.lit("text/plain"), F.lit("date"), F.concat(F.lit("at "), day))
    again = pages.select((number * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"),
                         F.when(number % 5 == 0, number - 3).otherwise(number + 7).alias("at"), F.lit(304).alias("status"), F.map_concat(own, common).alias("headers"))
    return full.unionByName(again)


_PARTS = r"'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\?([^#]*))?'"


@query(f"""
    with pieces as (
        select page_id, md5(coalesce(html, '')) as tag, 'day ' || (page_id % 28) as day, length(html) as n, url,
               regexp_replace(lower(regexp_extract(url, {_PARTS}, 1)), '^www[0-9]*\\.', '') as host,
               regexp_replace(regexp_extract(url, {_PARTS}, 2), '^:(80|443)?$', '') as port,
               regexp_replace(regexp_extract(url, {_PARTS}, 3), '/+$', '') as path,
               array_to_string(list_sort([p for p in string_split(regexp_extract(url, {_PARTS}, 4), '&')
                                          if p <> '' and not regexp_matches(lower(p), '{warc_revisits.TRACKING}')]), '&') as query
        from pages),
    named as (select *, host || port || path || case when query = '' then '' else '?' || query end as canonical_url from pieces),
    answers as (
        select page_id * 2 + 1 as record_id, canonical_url, case when page_id % 5 = 0 then page_id - 3 else page_id + 7 end as "at",
               case when page_id % 7 = 0 then 'other' when page_id % 3 = 0 then tag end as new_tag,
               case when page_id % 7 = 0 then '"other"' when page_id % 3 = 0 then 'W/"' || tag || '"' end as new_etag,
               case when page_id % 7 = 0 or page_id % 3 = 0 then null when page_id % 3 = 1 then day else 'day 3' end as new_day,
               'at ' || day as date
        from named),
    latest as (
        select a.*, r.page_id * 2 as response_id, r.tag, r.day, r.n,
               row_number() over (partition by a.record_id order by r.page_id desc) as place
        from answers a left join named r
          on r.canonical_url = a.canonical_url and (r.page_id < a."at" or (r.page_id = a."at" and r.page_id * 2 < a.record_id))),
    judged as (
        select *, case when response_id is null then 'orphan'
                       when coalesce(new_tag = tag, new_day = day, false) then 'resolved' else 'changed' end as outcome
        from latest where place = 1)
    select record_id, canonical_url, "at", outcome, case when outcome = 'resolved' then response_id end as response_id,
           case when outcome = 'resolved' then coalesce(new_etag, '"' || tag || '"') else new_etag end as etag,
           case when outcome = 'resolved' then coalesce(new_day, day) else new_day end as last_modified,
           'max-age=600' as cache_control, case when outcome = 'resolved' then 'text/html' else 'text/plain' end as content_type,
           case when outcome = 'resolved' then cast(n as varchar) end as content_length, date
    from judged""")
def op8_warc_revisits(spark, sf_dir):
    found = warc_revisits.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    header = {"etag": "etag", "last_modified": "last-modified", "cache_control": "cache-control", "content_type": "content-type",
              "content_length": "content-length", "date": "date"}
    return found.select("record_id", "canonical_url", "at", "outcome", "response_id",
                        *[F.element_at("headers", h).alias(c) for c, h in header.items()])


def _crc32_sql(text):
    """crc32 of an ASCII text in DuckDB, bit by bit."""
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint)"""


def repeat_tails(docs):
    """The documents with one in ten made periodic from some word on."""
    hashed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def damaged(w):
        n, g = F.size(w), F.floor(hashed / 10)
        first = (g % n).cast("int")
        period = (F.floor((n - first) / (3 + g % 8)) + 1).cast("int")
        times = F.ceil((n - first) / period).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, first + 1, period), times)), F.lit(1), n - first)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), first), tail), " "))

    # An array of one element binds the words, so that a text is split once.
    bound = F.get(F.transform(F.array(words), damaged), F.lit(0))
    return docs.select("doc_id", F.when(hashed % 10 == 0, F.coalesce(bound, F.lit(""))).otherwise(F.col("text")).alias("text"))


@query(rf"""
    with base as (
        select row_number() over () as row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
               {_crc32_sql("cast(doc_id as varchar)")} as h
        from documents),
    cut as (select *, len(w) as n, (h // 10) % greatest(len(w), 1) as a, h // 10 as g from base),
    text as (
        select row_no, doc_id, n, case when h % 10 = 0 and n > 0
                   then w[1:a] || list_transform(generate_series(0, n - a - 1), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + g % 8))])
                   else w end as w
        from cut),
    grams as (
        select row_no, i, w[i:i + 4] as gram
        from (select row_no, w, unnest(generate_series(1, len(w) - 4)) as i from text where len(w) >= 6)),
    -- All pairs of one five-word passage: every run starts with such pairs, one for each of its words but the last period and four.
    pairs as (
        select x.row_no, x.i, y.i - x.i as q from grams x join grams y on x.row_no = y.row_no and x.gram = y.gram and x.i < y.i),
    islands as (
        select row_no, q, min(i) - 1 as start, max(i) - min(i) + 5 + q as length
        from (select *, i - row_number() over (partition by row_no, q order by i) as island from pairs) group by row_no, q, island),
    runs as (
        select row_no, start, length, min(q) as period from islands where length >= greatest(6, 4 * q) group by row_no, start, length),
    dropped as (
        select distinct row_no, unnest(generate_series(start + period, start + length - 1)) as i from runs),
    kept as (
        select t.row_no, string_agg(t.word, ' ' order by t.i) as words
        from (select row_no, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from text) t
             left join dropped d on t.row_no = d.row_no and t.i = d.i where d.i is null group by t.row_no),
    said as (
        select row_no, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
               min(row(-length, start, period)) as first
        from runs group by row_no)
    select doc_id, coalesce(n_runs, 0) as n_runs, first[2] as start, -first[1] as length, first[3] as period,
           (-first[1] * 1000) // first[3] as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
    from text left join said using (row_no) left join kept using (row_no)""")
def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(repeat_tails(table(spark, sf_dir, "documents")))
    top = periodic_runs.longest(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.floor(top["length"] * 1000 / top["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op12_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def damage_turns(rows):
    """Conversations with some rows lost, emptied, cut short, repeated or given to the wrong role."""
    space = F.lit(" ")
    chance = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                              F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    held = rows.select("conv_id", "turn", F.when(chance == 4, "user").otherwise(role).alias("role"),
                       F.when(chance == 1, "").when(chance == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                       F.when(chance == 0, 0).when(chance == 3, 2).otherwise(1).alias("_times"))
    return held.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")


def _edit_sql(cell, cost, letter):
    """A cell (cost in nine digits, then the audit, so that texts compare like pairs) after one more edit."""
    return f"lpad(cast(cast(left({cell}, 9) as bigint) + {cost} as varchar), 9, '0') || substr({cell}, 10) || '{letter}'"


def _read_sql(cell, initial):
    """A cell after the row at hand is kept or reroled to be read as `initial`."""
    keep = f"case when not gone and initial = '{initial}' then {_edit_sql(cell, 'extra', 'K')} end"
    return keep if initial == "s" else f"least({keep}, case when not gone then {_edit_sql(cell, '2 + extra', 'R')} end)"


@query(rf"""
    with recursive hit as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               {_crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k
        from conversations),
    turns as (
        select conv_id, turn, case when k = 4 then 'user' else role end as role,
               case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
        from hit, (values (1), (2)) c(copy) where k <> 0 and (copy = 1 or k = 3)),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from turns),
    judged as (
        select *, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by place) as before,
               case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                    when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' end as fault
        from placed),
    chats as (
        select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
               count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
               count(*) filter (fault = 'truncated') as truncated,
               count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
        from judged group by conv_id),
    -- From left to right: the cheapest way to have read nothing, a system, a user or an assistant row last.
    walk as (
        select conv_id, n, 0 as place, '000000000' as c0, null::varchar as c1, '000000002I' as c2, '000000004II' as c3 from chats
        union all
        select conv_id, n, place, t0, t1, u2, least(t3, {_edit_sql('u2', 2, 'I')})
        from (select *, least(t2, {_edit_sql('t0', 2, 'I')}, {_edit_sql('t1', 2, 'I')}, {_edit_sql('t3', 2, 'I')}) as u2
              from (select conv_id, n, place, {_edit_sql('c0', 3, 'D')} as t0, least({_edit_sql('c1', 3, 'D')}, {_read_sql('c0', 's')}) as t1,
                           least({_edit_sql('c2', 3, 'D')}, {_read_sql('c0', 'u')}, {_read_sql('c1', 'u')}, {_read_sql('c3', 'u')}) as t2,
                           least({_edit_sql('c3', 3, 'D')}, {_read_sql('c2', 'a')}) as t3
                    from (select w.conv_id, w.n, j.place, c0, c1, c2, c3, initial, coalesce(fault, '') in ('blank', 'duplicate') as gone,
                                 case when fault = 'truncated' then 1 else 0 end as extra
                          from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.place = w.place + 1)))),
    best as (
        select conv_id, cast(left(least(c0, c3), 9) as bigint) as cost, substr(least(c0, c3), 10) as audit from walk where place = n),
    letters as (
        select conv_id, audit[i] as letter, i,
               count(*) filter (audit[i] <> 'I') over (partition by conv_id order by i) as place,
               count(*) filter (audit[i] <> 'D') over (partition by conv_id order by i) as made
        from (select conv_id, audit, unnest(generate_series(1, length(audit))) as i from best)),
    heads as (
        select l.conv_id from letters l join judged j on j.conv_id is not distinct from l.conv_id and j.place = l.place
        where made = 1 and letter = 'K' and initial = 's'),
    said as (
        select l.conv_id, string_agg(case when letter = 'K' then j.role else case when (made + h.n) % 2 = 1 then 'user' else 'assistant' end end
                                     || ':' || case when letter = 'I' then '' else j.text end, chr(10) order by i) as body
        from letters l
        left join judged j on j.conv_id is not distinct from l.conv_id and j.place = l.place
        join (select c.conv_id, (select count(*) from heads where heads.conv_id is not distinct from c.conv_id) as n from chats c) h
          on h.conv_id is not distinct from l.conv_id
        where letter <> 'D' group by l.conv_id)
    select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
           coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
    from (select distinct conv_id from conversations) o
    left join chats c on c.conv_id is not distinct from o.conv_id
    left join best b on b.conv_id is not distinct from o.conv_id
    left join said s on s.conv_id is not distinct from o.conv_id""")
def op13_conversation_repair(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations")
    found, rebuilt = conversation_repair.repair(damage_turns(chats))
    digests = conversation_repair.conversation_digests(rebuilt)
    every = chats.select("conv_id").distinct()
    both = every.join(found.withColumnRenamed("conv", "_c"), every["conv_id"].eqNullSafe(F.col("_c")), "left")
    both = both.join(digests.withColumnRenamed("conv", "_d"), both["conv_id"].eqNullSafe(F.col("_d")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
