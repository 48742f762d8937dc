"""DuckDB statements for the registered queries: the corpus views, then one statement per query."""

import numpy as np

from shotweave.functions.text import ACCENTED, PLAIN, STOP_WORDS
from shotweave.operators.encode import QUERY, hash_encoder

VIEWS = """with keyframes as (select vec_id keyframe_id, cast(floor(vec_id / 4) as bigint) scene_id, printf('%05d', cast(floor(vec_id / 20) as bigint)) video_id,
    cast(vec_id % 4 as integer) kf_index, cast((cast(floor(vec_id / 4) as bigint) % 5) * 8000 + (vec_id % 4) * 2000 as integer) ts_ms
    from (select vec_id from embeddings union select doc_id from documents where doc_id is not null union select page_id + 1000000 from pages where page_id is not null)),
scenes as (select *, shot_index * 8000 start_ms, shot_index * 8000 + 8000 end_ms from (select distinct scene_id, video_id, cast(scene_id % 5 as integer) shot_index from keyframes)),
videos as (select video_id, case n % 3 when 0 then 'V3C1' when 1 then 'V3C2' else 'MVK' end collection, 40000 duration_ms, n % 4 <> 3 has_audio, n % 13 = 5 damaged
    from (select distinct video_id, cast(video_id as integer) n from keyframes)),
keyframe_embedding as (select vec_id keyframe_id, 1 model_id, embedding from embeddings),
keyframe_text as (select doc_id keyframe_id, text ocr_text from documents where doc_id is not null),
transcript_segment as (select conv_id * 8 + turn segment_id, printf('%05d', conv_id) video_id, cast(turn * 5000 as integer) start_ms, cast(turn * 5000 + 7000 as integer) end_ms, text from conversations),
submissions as (select event_id, ts, cast(user_id as integer) code, cast(floor(event_id / 1000) as bigint) scene_id, printf('%05d', cast(floor(floor(event_id / 1000) / 5) as bigint)) video_id,
    case event_type when 'purchase' then 'CORRECT' when 'error' then 'WRONG' when 'click' then 'INDETERMINATE' when 'view' then 'UNDECIDABLE' end status from events),
job_events as (select printf('%05d', user_id) video_id, ts, event_id,
    case event_type when 'signup' then 'PENDING' when 'view' then 'FETCHED' when 'click' then 'DECODED' when 'purchase' then 'LOADED' when 'error' then 'FAILED' end stage from events),
keyframe_caption as (select doc_id keyframe_id, text caption from documents where doc_id % 4 = 0),
caption_embedding as (select vec_id - 1 keyframe_id, 10 model_id, embedding from embeddings where vec_id % 4 = 1),
transcript_embedding as (select segment_id, 10 model_id, embedding from (select segment_id, segment_id % (select count(*) from embeddings) vec_id from transcript_segment) join embeddings using (vec_id)),
files as (select unnest(list_filter([case when n % 3 = 0 then 'work/raw/' || video_id || '.mp4' end, case when n % 4 = 1 then 'work/raw/' || video_id || '.mkv' end, case when n % 5 < 3 then 'data/' || video_id || '.webm' end,
    case when n % 7 = 2 then 'data/' || video_id || '.mp4' end, case when n % 6 < 4 then 'web/' || video_id || '.mp4' end, case when n % 2 = 0 then 'shots/' || video_id || '.scenes.txt' end,
    case when n % 3 = 1 then 'shots/' || video_id || '.tsv' end, case when n % 11 = 0 then 'shots/9' || video_id || '.csv' end], lambda p: p is not null)) path from (select video_id, cast(video_id as integer) n from videos)),
named_files as (select path, regexp_extract(path, '([^/.]*)[^/]*$', 1) video_id, regexp_extract(path, '^(.*)/', 1) folder, regexp_extract(path, '[.]([^./]+)$', 1) kind from files),
sources as (select video_id, arg_min(path, struct_pack(f := case folder when 'work/raw' then 1 else 2 end, k := list_position(['mp4', 'mkv', 'webm', 'avi', 'mov'], kind))) path from named_files where folder in ('work/raw', 'data') group by video_id),
query_vectors as (select cast(vec_id as integer) query_id, embedding from embeddings where vec_id % 20 = 0),
embedded as (select * from keyframes semi join keyframe_embedding using (keyframe_id))
"""

#: More candidates than there are vectors: an exact search.
ALL = 1_000_000_000


def near(p: str, table: str, key: str, n: int, queries: str = "query_vectors") -> str:
    """Two-phase search: the n nearest sign codes, ranked by cosine distance, as <p>knn."""
    return f""", {p}bits as (select q.query_id, k.{key}, k.embedding e, q.embedding qe,
    cast(list_sum(list_transform(range(1, 65), lambda i: case when (k.embedding[i] > 0) <> (q.embedding[i] > 0) then 1 else 0 end)) as bigint) bits from {table} k, {queries} q),
{p}cand as (select * from {p}bits qualify row_number() over (partition by query_id order by bits, {key}) <= {n}),
{p}dist as (select query_id, {key}, round(1 - list_dot_product(cast(e as double[]), cast(qe as double[])) / sqrt(list_dot_product(cast(e as double[]), cast(e as double[])) * list_dot_product(cast(qe as double[]), cast(qe as double[]))), 6) distance from {p}cand),
{p}knn as (select *, cast(row_number() over (partition by query_id order by distance, {key}) as integer) rank from {p}dist)
"""


def expand(p: str, places: str, depth: int) -> str:
    """All keyframes of placed scenes (query_id, place, scene_id), as <p>."""
    return f""", {p} as (select query_id, scene_id, keyframe_id, cast(row_number() over (partition by query_id order by place, ts_ms, keyframe_id) as integer) rank from {places} join keyframes using (scene_id)
    qualify row_number() over (partition by query_id order by place, ts_ms, keyframe_id) <= {depth})
"""


def caption(n: int, depth: int, queries: str = "query_vectors") -> str:
    return near("c", "caption_embedding", "keyframe_id", n, queries) + f""", cplace as (select query_id, scene_id, row_number() over (partition by query_id order by c.rank, keyframe_id) place from cknn c join keyframes using (keyframe_id)
    qualify row_number() over (partition by query_id order by c.rank, keyframe_id) <= {depth})
""" + expand("caption", "cplace", depth)


def transcript(n: int, depth: int, segments: int = 500, queries: str = "query_vectors") -> str:
    return near("t", "transcript_embedding", "segment_id", n, queries) + f""", tfirst as (select query_id, scene_id, min(t.rank) hit from (select * from tknn where rank <= {segments}) t join transcript_segment x using (segment_id) join scenes s on s.video_id = x.video_id and s.start_ms < x.end_ms and s.end_ms > x.start_ms group by all),
tplace as (select query_id, scene_id, row_number() over (partition by query_id order by hit, scene_id) place from tfirst qualify place <= {depth})
""" + expand("transcript", "tplace", depth)


FOLDED = "replace(replace(replace(replace(translate(regexp_replace(lower(ocr_text), '[\u0300-\u036f]', '', 'g'), '" + ACCENTED + "', '" + PLAIN + "'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th')"
LEX = f"regexp_extract_all({FOLDED}, " + r"'[\p{L}\p{N}]+')"
ASKED = ", asked(k, words) as (values (0, ['the', 'der']), (1, ['der', 'que']), (2, ['the', 'que', 'und']))\n"


def ocr(stage: int = 0, depth: int = 200) -> str:
    """The OR search of a stage's words, as ocr<stage> (ocr for the first)."""
    p = str(stage or "")
    return f""", scored{p} as (select query_id, keyframe_id, scene_id, score, cast(row_number() over (partition by query_id order by score desc, keyframe_id) as integer) rank
    from hits join keyframes using (keyframe_id) join query_vectors on (query_id + {stage}) % 3 = k qualify rank <= {depth}),
ocr{p} as (select query_id, keyframe_id, scene_id, rank from scored{p})
"""


HITS = ASKED + f""", lex as (select keyframe_id, {LEX} w from keyframe_text),
counted as (select k, keyframe_id, len(list_filter(w, lambda x: list_contains(words, x))) n from lex, asked),
hits as (select k, keyframe_id, round(n * 0.1 / (n * 0.1 + 1), 6) score from counted where n > 0)
"""
OCR = HITS + ocr()
VISUAL = near("", "keyframe_embedding", "keyframe_id", ALL) + """, visual as (select query_id, keyframe_id, scene_id, cast(row_number() over (partition by query_id order by k.rank, keyframe_id) as integer) rank
    from knn k join keyframes using (keyframe_id) qualify row_number() over (partition by query_id order by k.rank, keyframe_id) <= 200)
"""
FUSED = VISUAL + OCR + """, ranked as (select *, 1.0 w from visual union all select *, 4.0 from ocr),
sums as (select query_id, keyframe_id, scene_id, sum(cast(w as double) / (60 + rank)) score from ranked group by all),
fused as (select query_id, keyframe_id, scene_id, round(score, 6) score, cast(row_number() over (partition by query_id order by round(score, 9) desc, keyframe_id) as integer) rank from sums qualify rank <= 48)
"""
FULL = VISUAL + OCR + caption(ALL, 200) + transcript(ALL, 200) + """, ranked as (select query_id, rank, scene_id, keyframe_id, 'visual' retriever, 1.0 w from visual union all select query_id, rank, scene_id, keyframe_id, 'text', 4.0 from ocr
    union all select query_id, rank, scene_id, keyframe_id, 'caption', 1.0 from caption union all select query_id, rank, scene_id, keyframe_id, 'speech', 1.0 from transcript),
parts as (select query_id, keyframe_id, scene_id, retriever, sum(cast(w as double) / (60 + rank)) part, min(rank) best from ranked group by all),
sums as (select query_id, keyframe_id, min(scene_id) scene_id, sum(part) score from parts group by all),
fused as (select query_id, keyframe_id, scene_id, round(score, 6) score, cast(row_number() over (partition by query_id order by round(score, 9) desc, keyframe_id) as integer) rank from sums qualify rank <= 48)
"""
WORDS = LEX.replace("ocr_text", "text")
PHRASE = f""", plex as (select segment_id, video_id, start_ms, end_ms, {WORDS} w from transcript_segment),
said(k, a) as (values (0, 'of'), (1, 'in'), (2, 'in')),
pn as (select *, len(list_filter(range(1, len(w)), lambda i: w[i] = a and w[i + 1] = 'the')) n from plex, said),
phrases as (select query_id, segment_id, round(n * 0.1 / (n * 0.1 + 1), 6) score, video_id, start_ms, end_ms from pn join query_vectors on query_id % 3 = k where n > 0)
"""


def staged(n: int) -> str:
    """The hits of n stages: a search each, with the same vector and words of its own."""
    sql = VISUAL.replace("<= 200)", "<= 500)") + HITS
    for k in range(n):
        sql += ocr(k, 500) + f""", ranked{k} as (select *, 1.0 w from visual union all select *, 4.0 from ocr{k or ''}),
sums{k} as (select query_id, keyframe_id, scene_id, sum(cast(w as double) / (60 + rank)) score from ranked{k} group by all),
fused{k} as (select *, row_number() over (partition by query_id order by round(score, 9) desc, keyframe_id) rank from sums{k} qualify rank <= 300),
hits{k} as (select f.query_id, k.video_id, f.scene_id, f.keyframe_id, k.ts_ms, f.score from fused{k} f join keyframes k using (keyframe_id))
"""
    return sql


def joined(first: str, then: str, gap: int) -> str:
    """Each hit of a stage with its best successor."""
    return f"""select a.*, b.keyframe_id next_id, b.ts_ms - a.ts_ms gap, a.score + b.reached reached, a.keyframe_id || ',' || b.path path
    from (select * exclude (reached, path) from {first}) a join {then} b on a.query_id = b.query_id and a.video_id = b.video_id and a.scene_id <> b.scene_id and b.ts_ms > a.ts_ms and b.ts_ms - a.ts_ms < {gap}
    qualify row_number() over (partition by a.query_id, a.video_id, a.keyframe_id order by round(b.reached, 9) desc, b.ts_ms, b.keyframe_id) = 1"""


BEST = """chains as (select * from pairs qualify row_number() over (partition by query_id, video_id order by round(reached, 9) desc, scene_id, keyframe_id) <= 3),
placed as (select *, cast(row_number() over (partition by query_id order by round(reached, 9) desc, scene_id, video_id, keyframe_id) as integer) rank from chains)
"""
ENDS = ", ".join(f"ends{k} as (select *, score reached, cast(keyframe_id as varchar) path from hits{k})" for k in range(3))
LINKED = staged(2) + ", " + ENDS.rsplit(", ends2", 1)[0] + f", pairs as ({joined('ends0', 'ends1', 9000)}), " + BEST
LINKED3 = staged(3) + ", " + ENDS + f", later as ({joined('ends1', 'ends2', 12000)}), pairs as ({joined('ends0', 'later', 9000)}), " + BEST
GRAMS = lambda s: f"list_distinct(flatten(list_transform({LEX.replace('ocr_text', s)}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIMILAR = lambda a, b: f"coalesce(len(list_intersect({GRAMS(a)}, {GRAMS(b)})) / nullif(len(list_distinct(list_concat({GRAMS(a)}, {GRAMS(b)}))), 0), 0)"

def of_text(text: str) -> str:
    """The vector of a query's text, as a literal."""
    v = hash_encoder()([QUERY + text])[0]
    return f"{(v / np.linalg.norm(v)).astype(np.float32).tolist()}::float[]"


#: The stages of sequences by their kind: 0 'the' and 1 'der', each with the phrase in recognised text; 2 and 3 without it; 4 the spoken phrase.
FREE = ["the", "der"]
KINDS = f""", kinds(query_id, embedding) as (values {", ".join(f"({k}, {of_text(FREE[k % 2])})" for k in range(4))}),
free(query_id, word) as (values {", ".join(f"({k}, '{FREE[k % 2]}')" for k in range(4))})
""" + near("", "keyframe_embedding", "keyframe_id", ALL, "kinds") + f""", visual as (select query_id, keyframe_id, scene_id, row_number() over (partition by query_id order by k.rank, keyframe_id) rank
    from knn k join keyframes using (keyframe_id) qualify row_number() over (partition by query_id order by k.rank, keyframe_id) <= 500)
""" + caption(ALL, 500, "kinds") + transcript(ALL, 500, 500, "kinds") + f""", lex as (select keyframe_id, ocr_text, {LEX} w from keyframe_text),
words_of as (select query_id, keyframe_id, len(list_filter(w, lambda x: x = word)) n from lex, free),
ocr as (select query_id, keyframe_id, scene_id, row_number() over (partition by query_id order by round(n * 0.1 / (n * 0.1 + 1), 6) desc, keyframe_id) rank from words_of join keyframes using (keyframe_id) where n > 0 qualify rank <= 500),
stood as (select keyframe_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) n from lex),
exact as (select keyframe_id, scene_id, round(n * 0.1 / (n * 0.1 + 1), 6) score, 0 source from stood join keyframes using (keyframe_id) where n > 0 qualify row_number() over (order by score desc, keyframe_id) <= 500),
alike as (select keyframe_id, scene_id, round({SIMILAR('ocr_text', "'of the'")}, 6) score, 1 source from keyframe_text join keyframes using (keyframe_id) where score >= 0.45 and scene_id not in (select scene_id from exact)),
phrase_found as (select keyframe_id, scene_id, row_number() over (order by source, score desc, keyframe_id) rank from (select * from exact union all select * from alike) qualify rank <= 500),
ocr_phrase as (select query_id, keyframe_id, scene_id, rank from phrase_found, (values (0), (1)) k(query_id)),
plex as (select segment_id, video_id, start_ms, end_ms, {WORDS} w from transcript_segment),
pn as (select *, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) n from plex),
heard as (select 4 query_id, scene_id, max(round(n * 0.1 / (n * 0.1 + 1), 6)) score from pn p join scenes s on s.video_id = p.video_id and s.start_ms < p.end_ms and s.end_ms > p.start_ms where n > 0 group by scene_id),
hplace as (select query_id, scene_id, row_number() over (order by score desc, scene_id) place from heard qualify place <= 500)
""" + expand("asr_phrase", "hplace", 500) + """, ranked as (select query_id, keyframe_id, scene_id, rank, 1.0 w, 'visual' retriever from visual union all select query_id, keyframe_id, scene_id, rank, 4.0, 'ocr' from ocr
    union all select query_id, keyframe_id, scene_id, rank, 1.0, 'caption' from caption union all select query_id, keyframe_id, scene_id, rank, 1.0, 'transcript' from transcript
    union all select query_id, keyframe_id, scene_id, rank, 8.0, 'ocr_phrase' from ocr_phrase union all select query_id, keyframe_id, scene_id, rank, 8.0, 'asr_phrase' from asr_phrase),
parts as (select query_id, keyframe_id, scene_id, retriever, sum(cast(w as double) / (60 + rank)) part from ranked group by all),
sums as (select query_id kind, keyframe_id, min(scene_id) scene_id, list_sum(list(part order by retriever)) score from parts group by all),
fused as (select * from sums qualify row_number() over (partition by kind order by round(score, 9) desc, keyframe_id) <= 1000),
asked as (select query_id, case query_id % 3 when 1 then 1 else 0 end first_, case (query_id + 1) % 3 when 1 then 3 else 2 end then_ from query_vectors),
hit as (select kind, keyframe_id, f.scene_id, score, video_id, ts_ms from fused f join keyframes using (keyframe_id)),
hits0 as (select query_id, video_id, scene_id, keyframe_id, ts_ms, score from asked join hit on kind = first_),
hits1 as (select query_id, video_id, scene_id, keyframe_id, ts_ms, score from asked join hit on kind = then_),
hits2 as (select query_id, video_id, scene_id, keyframe_id, ts_ms, score from asked join hit on kind = 4 where query_id % 40 = 0),
""" + ENDS + f""", later as ({joined('ends1', 'ends2', 12000)}),
two as ({joined('ends0', 'ends1', 9000)}), three as ({joined('ends0', 'later', 9000)}),
full_ as (select query_id, video_id from hits0 semi join hits2 using (query_id, video_id)),
pairs as (select query_id, video_id, scene_id, keyframe_id, reached, path from two where query_id % 40 <> 0 union all select query_id, video_id, scene_id, keyframe_id, reached, path from three),
""" + BEST
LOG_STAGES = """, w(k, words) as (values (0, 'the der'), (1, 'der que'), (2, 'the que und')),
s as (select query_id, 0 stage, a.words free_text, case when query_id % 7 = 0 then 'of the' else '' end ocr_phrase, '' asr_phrase, 0::bigint gap_ms from query_vectors join w a on a.k = query_id % 3
    union all select query_id, 1, b.words, '', '', 9000 from query_vectors join w b on b.k = (query_id + 1) % 3 where query_id % 40 = 0
    union all select query_id, 2, '', '', 'of the', 12000 from query_vectors where query_id % 40 = 0)
select *, 1 model_id, case when query_id % 60 = 0 then '00001,00003' when query_id % 9 = 0 then '00003' else '' end excluded from s"""

SAID = ["the der", "der que", "the que und"]


def logged(chains: bool) -> str:
    """Fused hits (query_id, stage, keyframe_id, scene_id, score, rank) of the log's requests with one stage, or with several."""
    depth, limit = (500, 1000) if chains else (200, 48)
    stages = """select query_id, 0 stage, query_id % 3 kind, query_id % 7 = 0 written, false spoken from query_vectors where query_id % 40 = 0
    union all select query_id, 1, (query_id + 1) % 3, false, false from query_vectors where query_id % 40 = 0
    union all select query_id, 2, null, false, true from query_vectors where query_id % 40 = 0"""
    stages = stages if chains else "select query_id, 0 stage, query_id % 3 kind, query_id % 7 = 0 written, false spoken from query_vectors where query_id % 40 <> 0"
    top = lambda order, name="pos": f"row_number() over (partition by s.query_id, stage order by {order}) {name}"
    return f""", kinds(query_id, embedding, words) as (values {", ".join(f"({k}, {of_text(t)}, {t.split()})" for k, t in enumerate(SAID))}),
stages as ({stages}),
may as (select query_id, keyframe_id, scene_id, ts_ms, k.video_id from query_vectors q, keyframes k join videos v using (video_id)
    where (q.query_id // 20 % 3 = 2 or v.collection = case q.query_id // 20 % 3 when 0 then 'MVK' else 'V3C2' end)
    and not (q.query_id % 60 = 0 and k.video_id in ('00001', '00003')) and not (q.query_id % 9 = 0 and k.video_id = '00003')),
""" + SOURCED[2:] + near("", "keyframe_embedding", "keyframe_id", ALL, "kinds") + near("c", "caption_embedding", "keyframe_id", ALL, "kinds") + near("t", "transcript_embedding", "segment_id", ALL, "kinds") + f""",
visual as (select s.query_id, stage, m.keyframe_id, scene_id, {top('d.distance, m.keyframe_id')} from stages s join knn d on d.query_id = kind join may m on m.query_id = s.query_id and m.keyframe_id = d.keyframe_id qualify pos <= {depth}),
cplace as (select s.query_id, stage, scene_id, {top('d.distance, m.keyframe_id', 'place')} from stages s join cknn d on d.query_id = kind join may m on m.query_id = s.query_id and m.keyframe_id = d.keyframe_id qualify place <= {depth}),
caption as (select s.query_id, stage, k.keyframe_id, scene_id, {top('s.place, ts_ms, k.keyframe_id')} from cplace s join keyframes k using (scene_id) qualify pos <= {depth}),
okay as (select distinct query_id, scene_id from may),
tfirst as (select kind, scene_id, min(d.rank) hit from (select query_id kind, segment_id, rank from tknn where rank <= 500) d join transcript_segment x using (segment_id) join scenes c on c.video_id = x.video_id and c.start_ms < x.end_ms and c.end_ms > x.start_ms group by all),
tplace as (select s.query_id, stage, scene_id, {top('hit, scene_id', 'place')} from stages s join tfirst using (kind) join okay o using (query_id, scene_id) qualify place <= {depth}),
transcript as (select s.query_id, stage, k.keyframe_id, scene_id, {top('s.place, ts_ms, k.keyframe_id')} from tplace s join keyframes k using (scene_id) qualify pos <= {depth}),
lex as (select keyframe_id, ocr_text, {LEX} w from keyframe_text),
counted as (select query_id kind, keyframe_id, len(list_filter(w, lambda x: list_contains(words, x))) n from lex, kinds),
ocr as (select s.query_id, stage, keyframe_id, scene_id, {top('round(n * 0.1 / (n * 0.1 + 1), 6) desc, keyframe_id')} from stages s join counted using (kind) join may m using (query_id, keyframe_id) where n > 0 qualify pos <= {depth}),
stood as (select keyframe_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) n from lex),
exact as (select s.query_id, stage, keyframe_id, scene_id, round(n * 0.1 / (n * 0.1 + 1), 6) score, 0 source, {top('round(n * 0.1 / (n * 0.1 + 1), 6) desc, keyframe_id')} from stages s join may m using (query_id) join stood using (keyframe_id) where written and n > 0 qualify pos <= {depth}),
near_ as (select keyframe_id, round({SIMILAR('ocr_text', "'of the'")}, 6) score from keyframe_text where score >= 0.45),
alike as (select s.query_id, stage, keyframe_id, scene_id, score, 1 source from stages s join may m using (query_id) join near_ using (keyframe_id) where written and not exists (select 1 from exact e where e.query_id = s.query_id and e.stage = s.stage and e.scene_id = m.scene_id)),
ocr_phrase as (select s.query_id, stage, keyframe_id, scene_id, {top('source, score desc, keyframe_id')} from (select * exclude (pos) from exact union all select * from alike) s qualify pos <= {depth}),
plex as (select segment_id, video_id, start_ms, end_ms, {WORDS} w from transcript_segment),
pn as (select *, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' and w[i + 1] = 'the')) n from plex),
heard as (select scene_id, max(round(n * 0.1 / (n * 0.1 + 1), 6)) score from pn p join scenes c on c.video_id = p.video_id and c.start_ms < p.end_ms and c.end_ms > p.start_ms where n > 0 group by scene_id),
hplace as (select s.query_id, stage, scene_id, {top('score desc, scene_id', 'place')} from stages s join okay using (query_id) join heard using (scene_id) where spoken qualify place <= {depth}),
asr_phrase as (select s.query_id, stage, k.keyframe_id, scene_id, {top('s.place, ts_ms, k.keyframe_id')} from hplace s join keyframes k using (scene_id) qualify pos <= {depth}),
ranked as ({" union all ".join(f"select query_id, stage, keyframe_id, scene_id, pos rank, {w} w, '{r}' retriever from {r}" for r, w in (("visual", 1.0), ("ocr", 4.0), ("caption", 1.0), ("transcript", 1.0), ("ocr_phrase", 8.0), ("asr_phrase", 8.0)))}),
parts as (select query_id, stage, keyframe_id, scene_id, retriever, sum(cast(w as double) / (60 + rank)) part from ranked semi join permitted using (query_id, retriever) group by all),
sums as (select query_id, stage, keyframe_id, min(scene_id) scene_id, list_sum(list(part order by retriever)) score from parts group by all),
fused as (select *, cast(row_number() over (partition by query_id, stage order by round(score, 9) desc, keyframe_id) as integer) rank from sums qualify rank <= {limit})
"""


RECORDS = """, w as (select * replace (coalesce(status, 'INDETERMINATE') as status) from submissions),
f as (select *, min(case when status in ('CORRECT', 'WRONG', 'UNDECIDABLE') then struct_pack(ts := ts, event_id := event_id) end) over (partition by code, scene_id) cut from w),
g as (select * from f where cut is null or status in ('CORRECT', 'WRONG', 'UNDECIDABLE') or struct_pack(ts := ts, event_id := event_id) < cut),
records as (select code, scene_id, arg_max(status, struct_pack(ts := ts, event_id := event_id)) status, any_value(video_id) video_id, max(event_id) last_event from g group by code, scene_id)
"""

SOURCED = """, sourced as (select query_id, case query_id // 20 % 4 when 0 then [' ASR ', 'nowhere'] when 1 then ['ocr', 'visual'] when 2 then ['sound'] else [] end asked, case query_id // 20 % 3 when 0 then 'mvk' when 1 then 'V3C2' end collection from query_vectors),
permitted as (select query_id, unnest(list_concat(case query_id // 20 % 4 when 0 then ['transcript'] when 1 then ['visual', 'ocr'] when 2 then [] else ['visual', 'ocr', 'transcript', 'caption'] end, ['ocr_phrase', 'asr_phrase'])) retriever from sourced)
"""
LOG_RESULTS = logged(False) + "select query_id, rank, keyframe_id, scene_id, video_id, round(score, 6) score from fused join keyframes using (keyframe_id, scene_id)"
LOG_CHAINS = logged(True) + ", hit as (select query_id, stage, k.video_id, f.scene_id, keyframe_id, k.ts_ms, score from fused f join keyframes k using (keyframe_id)), " + ", ".join(f"hits{k} as (select * exclude (stage) from hit where stage = {k})" for k in range(3)) + ", " + ENDS + f""", later as ({joined('ends1', 'ends2', 12000)}), pairs as ({joined('ends0', 'later', 9000)}),
""" + BEST + "select query_id, rank, video_id, round(reached, 6) score, path from placed where rank <= 48"

WORDS_OF = r"regexp_extract_all(text, '[\p{L}]+|[0-9]+')"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUERY_WORDS = f""", said as (select segment_id, {WORDS_OF} w from transcript_segment),
useful as (select segment_id, list_filter(w, lambda x, i: i > 1 and regexp_matches(x, '^\\p{{Lu}}') and lower(x) not in ({STOPS})) proper, list_filter(w, lambda x: len(x) >= 3 and lower(x) not in ({STOPS})) plain from said),
chosen as (select segment_id, list_transform(case when len(proper) > 0 then proper else plain end, lambda x: lower(x)) c from useful)
select segment_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ' ') tokens from chosen"""
SCALARS = """select segment_id, cast(greatest(2, least(32, ceil(ms / 4000))) as integer) keyframes,
    case when h >= 360000 then (h // 360000) || ':' else '' end || printf('%02d:%02d.%02d', h // 6000 % 60, h // 100 % 60, h % 100) code, h * 10 back,
    case when d < 60 then d || 's' when d < 3600 then printf('%dm %02ds', d // 60, d % 60) else printf('%dh %02dm', d // 3600, d // 60 % 60) end length,
    case when g < 60 then '+' || g || 's' else printf('+%dm %02ds', g // 60, g % 60) end gap,
    cast(floor(ms / 1000 * 25 + 0.5) as bigint) frame, cast(greatest(1, round_even((25 + segment_id % 7) / 2, 0)) as integer) stride, cast(ceil(ms / 12) as integer) expected,
    segment_id % 5 / 1000 <= 0.002 blank, case when segment_id % 3 = 0 then 'error' when segment_id % 4 = 2 then 'pending' else 'success' end verdict,
    round(n * 0.1 / (n * 0.1 + 1), 6) cover, greatest(1, cast(ceil(segment_id % 50 / 12) as bigint) + 1) first, least(90, cast(floor(ms / 40 / 12) as bigint) + 1) last
from (select segment_id, cast(start_ms + segment_id % 977 as bigint) ms, cast(segment_id % 5 as integer) n, cast(floor((ms * 90 + 5) / 10) as bigint) h, cast(floor(ms / 50 + 0.5) as bigint) d, cast(floor(ms / 1000 + 0.5) as bigint) g from transcript_segment)"""
STAGE_REPORTS = ", r as (" + " union all ".join(
    [
        "select 'text' stage, case when x.keyframe_id is null then 'pending' when trim(ocr_text) = '' then 'silent' else 'with_text' end status from keyframes k left join keyframe_text x using (keyframe_id)",
        "select 'captions', case when x.keyframe_id is null then 'pending' when trim(caption) = '' then 'silent' else 'with_text' end from keyframes k left join keyframe_caption x using (keyframe_id) where kf_index = 0",
        "select 'transcripts', case when not has_audio then 'skipped' when x is null then 'pending' when trim(x) = '' then 'silent' else 'with_text' end from videos left join (select video_id, max(text) x from transcript_segment group by video_id) using (video_id)",
        "select 'vectors', case when x.keyframe_id is null then 'pending' else 'with_text' end from keyframes k left join keyframe_embedding x using (keyframe_id)",
        "select 'caption_vectors', case when x.keyframe_id is null then 'pending' else 'with_text' end from keyframe_caption k left join (select distinct keyframe_id from caption_embedding) x using (keyframe_id)",
    ]
) + ") select stage, status, count(*) n from r group by all"
CASCADED = ", vl as (select video_id from videos where not damaged), kl as (select * from keyframes semi join vl using (video_id)), cl as (select * from keyframe_caption semi join kl using (keyframe_id)), tl as (select * from transcript_segment semi join vl using (video_id)) " + " union all ".join(
    f"select '{name}' as \"table\", count(*) as \"rows\" from {rest}"
    for name, rest in {"scenes": "scenes semi join vl using (video_id)", "keyframes": "kl", "keyframe_text": "keyframe_text semi join kl using (keyframe_id)", "keyframe_caption": "cl", "keyframe_embedding": "keyframe_embedding semi join kl using (keyframe_id)", "caption_embedding": "caption_embedding semi join cl using (keyframe_id)", "transcript_segment": "tl", "transcript_embedding": "transcript_embedding semi join tl using (segment_id)"}.items()
)
VIOLATIONS = " union all ".join(
    [
        "select 'past the end' as rule, 'transcript_segment' as \"table\", cast(segment_id as varchar) key, 'end_ms=' || end_ms || ' duration_ms=' || duration_ms detail from transcript_segment join videos using (video_id) where end_ms > duration_ms",
        "select 'no videos', 'transcript_segment', cast(segment_id as varchar), 'video_id=' || video_id from transcript_segment anti join videos using (video_id)",
        "select 'no keyframe_caption', 'caption_embedding', cast(keyframe_id as varchar), 'keyframe_id=' || keyframe_id from caption_embedding anti join keyframe_caption using (keyframe_id)",
        "select 'time order', 'transcript_segment', cast(segment_id as varchar), 'start_ms=' || start_ms || ' end_ms=' || end_ms from transcript_segment where end_ms < start_ms",
        "select 'no videos', 'keyframes', cast(keyframe_id as varchar), 'video_id=' || video_id from keyframes anti join videos using (video_id)",
        "select 'ocr_text is null', 'keyframe_text', cast(keyframe_id as varchar), 'ocr_text=null' from keyframe_text where ocr_text is null",
        "select 'caption is null', 'keyframe_caption', cast(keyframe_id as varchar), 'caption=null' from keyframe_caption where caption is null",
    ]
)

_BODIES = {
    "corpus_counts": " union all ".join(f"select '{t}' \"table\", count(*) \"rows\" from {t}" for t in ("keyframes", "scenes", "videos", "keyframe_embedding", "keyframe_text", "keyframe_caption", "caption_embedding", "transcript_segment", "transcript_embedding", "submissions", "job_events", "query_vectors")),
    "corpus_violations": VIOLATIONS,
    "pending_text": "select keyframe_id from keyframes where keyframe_id not in (select keyframe_id from keyframe_text)",
    "pending_captions": "select keyframe_id from keyframes where kf_index = 0 and keyframe_id % 3 = 1 and keyframe_id not in (select keyframe_id from keyframe_caption)",
    "pending_transcripts": "select video_id from videos where has_audio and collection = 'V3C1' and video_id not in (select video_id from transcript_segment)",
    "pending_text_vectors": "select keyframe_id from keyframe_caption where trim(caption) <> '' and keyframe_id not in (select keyframe_id from caption_embedding)",
    "pending_counts": "select 'vectors' stage, count(*) n from keyframes where keyframe_id not in (select keyframe_id from keyframe_embedding) union all select 'text', count(*) from keyframes where keyframe_id not in (select keyframe_id from keyframe_text) union all select 'captions', count(*) from keyframes where keyframe_id not in (select keyframe_id from keyframe_caption) union all select 'transcripts', count(*) from videos where has_audio and video_id not in (select video_id from transcript_segment) union all select 'caption_vectors', count(*) from keyframe_caption where trim(caption) <> '' and keyframe_id not in (select keyframe_id from caption_embedding) union all select 'transcript_vectors', count(*) from transcript_segment where trim(text) <> '' and segment_id not in (select segment_id from transcript_embedding)",
    "videos_complete": "select video_id from videos v where exists (select 1 from scenes s where s.video_id = v.video_id) and not exists (select 1 from scenes s where s.video_id = v.video_id and s.scene_id not in (select k.scene_id from keyframes k join keyframe_embedding using (keyframe_id)))",
    "browse_videos": "select v.video_id, v.collection, 40 as seconds, c.keyframe_id, (select count(*) from scenes s where s.video_id = v.video_id) scenes from (select * from videos order by video_id limit 10) v left join (select s.video_id, k.keyframe_id from scenes s join keyframes k using (scene_id) qualify row_number() over (partition by s.video_id order by shot_index, abs(ts_ms - floor((start_ms + end_ms) / 2)), keyframe_id) = 1) c using (video_id)",
    "browse_scenes": "select scene_id, shot_index, start_ms, end_ms, cast(len(k) as integer) keyframes, k[cast(floor(len(k) / 2) as integer) + 1] thumbnail from (select s.scene_id, s.shot_index, s.start_ms, s.end_ms, list(keyframe_id order by ts_ms, keyframe_id) k from scenes s join keyframes k using (scene_id) where s.video_id = '00002' group by all)",
    "overlapping_segments": "select segment_id from (select segment_id, start_ms, lag(end_ms) over (partition by video_id order by segment_id) before from transcript_segment) where start_ms < before",
    "retrieve_visual": near("", "keyframe_embedding", "keyframe_id", ALL) + "select query_id, cast(row_number() over (partition by query_id order by x.rank, keyframe_id) as integer) rank, scene_id, keyframe_id from knn x join keyframes using (keyframe_id) where video_id <> '00002' qualify row_number() over (partition by query_id order by x.rank, keyframe_id) <= 50",
    "retrieve_caption": caption(ALL, 50) + "select query_id, rank, scene_id, keyframe_id from caption",
    "retrieve_transcript": transcript(ALL, 50) + "select query_id, rank, scene_id, keyframe_id from transcript",
    "retrieve_ocr_indexed": OCR + "select query_id, keyframe_id, score from hits join query_vectors on query_id % 3 = k",
    "phrase_in_transcripts": PHRASE + "select query_id, segment_id, score from phrases",
    "retrieve_asr_phrase": PHRASE + """, scored as (select query_id, scene_id, max(score) score from phrases p join scenes s on s.video_id = p.video_id and s.start_ms < p.end_ms and s.end_ms > p.start_ms group by all),
places as (select query_id, scene_id, row_number() over (partition by query_id order by score desc, scene_id) place from scored qualify place <= 50)""" + expand("found", "places", 50) + "select query_id, rank, scene_id, keyframe_id from found",
    "trigram_pairs": f"select keyframe_id, round({SIMILAR('ocr_text', "'of the and in that this'")}, 6) sim from keyframe_text",
    "similar_transcripts": f""", s as (select segment_id, {GRAMS('text')} g from transcript_segment), q as (select segment_id query_id, g h from s where segment_id % 20 = 0)
select query_id, segment_id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) score from s, q where len(g) > 0 and len(h) > 0 and score >= 0.45""",
    "retrieve_ocr_phrase": f""", elex as (select keyframe_id, ocr_text, {LEX} w from keyframe_text),
said(k, a) as (values (0, 'of'), (1, 'in'), (2, 'in')),
en as (select *, len(list_filter(range(1, len(w)), lambda i: w[i] = a and w[i + 1] = 'the')) n from elex, said),
exact as (select query_id, keyframe_id, scene_id, round(n * 0.1 / (n * 0.1 + 1), 6) score, 0 source from en join keyframes using (keyframe_id) join query_vectors on query_id % 3 = k where n > 0 qualify row_number() over (partition by query_id order by score desc, keyframe_id) <= 50),
sim as (select keyframe_id, k, round({SIMILAR('ocr_text', "a || ' the and in that this'")}, 6) score from keyframe_text, said),
alike as (select query_id, keyframe_id, scene_id, score, 1 source from sim join keyframes using (keyframe_id) join query_vectors q on query_id % 3 = k where score >= 0.45 and not exists (select 1 from exact e where e.query_id = q.query_id and e.scene_id = keyframes.scene_id)),
found as (select *, cast(row_number() over (partition by query_id order by source, score desc, keyframe_id) as integer) rank from (select * from exact union all select * from alike))
select query_id, rank, scene_id, keyframe_id from found where rank <= 50""",
    "similar_keyframes": ", given as (select keyframe_id query_id, embedding from keyframe_embedding where keyframe_id % 20 = 0)" + near("", "keyframe_embedding", "keyframe_id", ALL).replace("query_vectors q", "given q") + "select query_id, cast(x.rank as integer) rank, scene_id, keyframe_id, round(1.0 / x.rank, 6) score from knn x join keyframes using (keyframe_id) where x.rank <= 11 and query_id <> keyframe_id",
    "search_full": FULL + "select * from fused",
    "signal_labels": FULL + "select p.query_id, p.keyframe_id, retriever label, cast(best as integer) best, round(part, 6) share, cast(row_number() over (partition by p.query_id, p.keyframe_id order by round(part, 9) desc, best, retriever) as integer) place from parts p join fused f on f.query_id = p.query_id and f.keyframe_id = p.keyframe_id",
    "link_two_stages": LINKED + "select query_id, video_id, keyframe_id, round(reached, 6) score, next_id as second, gap from chains",
    "chains_enriched": LINKED + "select query_id, rank, round(reached, 6) score, a.video_id || '/' || a.scene_id % 5 || '/' || a.keyframe_id || ',' || a.video_id || '/' || b.scene_id % 5 || '/' || next_id scenes from placed a join keyframes b on b.keyframe_id = next_id where rank <= 100",
    "link_three_stages": LINKED3 + "select query_id, video_id, keyframe_id, rank, round(reached, 6) score, path from placed where rank <= 200",
    "farthest_points": ", v as (select scene_id, keyframe_id, ts_ms, cast(embedding as double[]) e from keyframes join keyframe_embedding using (keyframe_id)), mean as (select scene_id, list(m order by d) c, any_value(n) n from (select scene_id, d, avg(e[d]) m, count(*) n from v, unnest(range(1, 65)) t(d) group by scene_id, d) group by scene_id), one as (select scene_id, keyframe_id, ts_ms, e, n from v join mean using (scene_id) qualify n <= 2 or row_number() over (partition by scene_id order by round(list_distance(e, c), 9), ts_ms, keyframe_id) = 1), two as (select v.scene_id, v.keyframe_id, v.ts_ms from v join one using (scene_id) where n > 2 qualify row_number() over (partition by v.scene_id order by round(list_distance(v.e, one.e), 9) desc, v.ts_ms, v.keyframe_id) = 1), every as (select scene_id, keyframe_id, ts_ms from one union select * from two) select scene_id, keyframe_id, cast(row_number() over (partition by scene_id order by ts_ms, keyframe_id) - 1 as integer) place from every",
    "event_hours": "select date_trunc('hour', ts) as start, event_type, count(*) n from events group by all",
    "sliding_hours": "select time_bucket(interval '30 minutes', ts) - to_minutes(30 * k) as start, event_type, count(*) n from (select distinct on (event_id) * from events), unnest(range(0, 4)) t(k) group by all",
    "user_sessions": "select min(ts) as start, user_id, count(*) n from (select *, sum(new) over (partition by user_id order by ts, event_id) s from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) <= 1800000000 then 0 else 1 end new from events)) group by user_id, s",
    "live_sessions": ", a as (select user_id code, max(ts) last from events where event_type not in ('view', 'click') group by user_id) select cast(code as bigint) code, 180 * 60000 - (epoch_ms(timestamp '2024-01-31 00:00:00') - cast(floor(epoch_us(last) / 1000) as bigint)) expires_in_ms from a where epoch_ms(timestamp '2024-01-31 00:00:00') - cast(floor(epoch_us(last) / 1000) as bigint) <= 180 * 60000",
    "live_snapshots": RECORDS + "select code, count(*) instances, count(distinct video_id) distinct_videos, count(distinct case when status in ('CORRECT', 'INDETERMINATE') then video_id end) covered_videos from records group by code",
    "purge_files": ", listed as (select unnest(list_filter([case when n % 3 = 0 then {'kind': 'raw', 'path': 'work/raw/' || video_id || '.mp4', 'bytes': n * 1000} end, case when n % 2 = 0 then {'kind': 'candidates', 'path': 'work/candidates/' || video_id || '/00001.jpg', 'bytes': n * 1000 + 2} end, case when n % 5 < 3 then {'kind': 'audio', 'path': 'work/audio/' || video_id || '.wav', 'bytes': n * 1000 + 3} end], lambda f: f is not null)) f, video_id, n from (select video_id, cast(video_id as bigint) n from videos)), complete as (select video_id from videos v where not exists (select 1 from scenes s where s.video_id = v.video_id and s.scene_id not in (select scene_id from embedded))), heard as (select video_id from videos where not has_audio or video_id in (select video_id from transcript_segment)) select f.kind as kind, video_id, f.path as path, f.bytes as bytes from listed where (f.kind = 'raw' and n % 6 < 4 and n % 2 = 0) or (f.kind = 'candidates' and video_id in (select video_id from complete)) or (f.kind = 'audio' and video_id in (select video_id from heard))",
    "stage_reports": STAGE_REPORTS,
    "cascaded_rows": CASCADED,
    "query_stages": r""", w as (select segment_id query_id, array_to_string(regexp_extract_all(trim(regexp_replace(text, '[">]', '', 'g')), '\S+'), ' ') w from transcript_segment)
select query_id, 0 stage, w free_text, 'shop' ocr_phrase, cast(null as varchar) asr_phrase, cast(null as bigint) gap_ms from w union all select query_id, 1, w, null, null, 30000 from w where w <> ''
union all select query_id, case when w = '' then 1 else 2 end, '', null, 'hello there', 60000 from w""",
    "query_words": QUERY_WORDS,
    "recall_at_20": near("", "keyframe_embedding", "keyframe_id", ALL) + near("a", "keyframe_embedding", "keyframe_id", 40) + near("b", "keyframe_embedding", "keyframe_id", 1000) + "select query_id, round(count(*) filter (exists (select 1 from aknn a where a.query_id = k.query_id and a.keyframe_id = k.keyframe_id and a.rank <= 20)) / count(*), 6) recall, 40 oversample from knn k where rank <= 20 group by query_id union all select query_id, round(count(*) filter (exists (select 1 from bknn a where a.query_id = k.query_id and a.keyframe_id = k.keyframe_id and a.rank <= 20)) / count(*), 6), 1000 from knn k where rank <= 20 group by query_id",
    "first_frame_share": FUSED + "select query_id, round(avg(case when kf_index = 0 then 1 else 0 end), 6) share from fused join keyframes using (keyframe_id) where rank <= 15 group by query_id",
    "score_range": OCR + "select 'ocr' retriever, min(score) low, max(score) high from scored where rank <= 20",
    "session_expiry": "select code, instance, min(event_id) first_event, max(event_id) last_event, count(*) writes from (select *, cast(sum(case when gap > 600 then 1 else 0 end) over (partition by code order by ts, event_id) as bigint) instance from (select *, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) over (partition by code order by ts, event_id))) gap from submissions)) group by code, instance",
    "job_status": ", state as (select video_id, arg_max(stage, struct_pack(ts := ts, event_id := event_id)) stage from job_events group by video_id) select collection, stage, count(*) n from state join videos using (video_id) group by all",
    "queued_scenes": ", state as (select video_id, arg_max(stage, struct_pack(ts := ts, event_id := event_id)) stage from job_events group by video_id), queue as (select video_id from state where stage <> 'FAILED') select scene_id from scenes where video_id in (select video_id from queue) or not exists (select 1 from queue)",
    "lexeme_counts": f"select token, count(*) n from (select unnest({LEX}) token from keyframe_text) group by token",
    "scalar_rules": SCALARS,
    "unit_vectors": "select vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) first, round(1 - list_dot_product(e, list_reverse(e)) / list_dot_product(e, e), 6) mirror, cast(list_sum(list_transform(range(1, 65), lambda i: case when (e[i] > 0) <> (e[65 - i] > 0) then 1 else 0 end)) as integer) bits from (select vec_id, cast(embedding as double[]) e from embeddings)",
    "shot_boundaries": "select video_id, shot_index, cast(start_ms / 40 as bigint) start_frame, cast(end_ms / 40 as bigint) end_frame, cast(start_ms as bigint) start_ms, cast(end_ms as bigint) end_ms from scenes",
    "source_files": "select video_id, path from videos left join sources using (video_id)",
    "paired_files": ", b as (select video_id, arg_min(path, list_position(['txt', 'tsv', 'csv'], kind)) boundary from named_files where folder = 'shots' group by video_id) select video_id, path video, boundary, case when boundary is null then 'no_boundary' when path is null then 'no_video' else 'paired' end state from sources full join b using (video_id)",
    "decode_worklist": "select video_id, path, case when path is null then 'missing' else 'ready' end state from videos left join sources using (video_id) where not (video_id in (select video_id from embedded) and video_id in (select video_id from named_files where folder = 'web'))",
    "select_worklist": "select video_id from videos where video_id in (select video_id from scenes) and video_id not in (select video_id from embedded)",
    "decode_report": ", log as (select event_id % 120 n, stage = 'FAILED' bad from job_events), o as (select n, case when n >= 80 * 0.98 then 'ok' when n > 0 and bad then 'damaged' else 'failed' end outcome from log) select count(*) videos, count(*) filter (outcome <> 'failed') decoded, count(*) filter (outcome = 'damaged') damaged, count(*) filter (outcome = 'failed') failed, cast(sum(n) as bigint) candidates from o",
    "caption_report": "select case when c.keyframe_id is null then 'pending' when trim(caption) = '' then 'silent' else 'with_text' end status, count(*) n from keyframes k left join keyframe_caption c using (keyframe_id) where kf_index = 0 group by all",
    "keyframe_fallbacks": ", cand as (select scene_id, cast(ts_ms / 40 as bigint) frame, abs(embedding[1]) std, scene_id % 3 = 1 or kf_index = 0 bad from keyframes join embeddings on vec_id = keyframe_id), best as (select scene_id, bool_and(bad) blank, arg_max(frame, struct_pack(std := std, f := -frame)) frame from cand group by scene_id) select scene_id, case when blank is null then 'middle' else 'textured' end rule, coalesce(frame, cast((start_ms + end_ms) / 80 as bigint)) frame from scenes left join best using (scene_id) where blank is null or blank",
    "recognised_text": "select keyframe_id, array_to_string(list_filter(list_transform(list_filter(string_split(ocr_text, ' '), lambda w: len(w) >= 5), lambda w: trim(w)), lambda w: w <> ''), ' ') \"text\" from keyframe_text",
    "enqueue_manifest": "select video_id, 'V3C1' collection, min(path) source_uri from named_files where folder in ('work/raw', 'data') and video_id not in (select video_id from job_events) group by video_id",
    "permitted_retrievers": SOURCED + "select * from permitted",
    "search_gated": FUSED.replace(", ranked as (select *, 1.0 w from visual union all select *, 4.0 from ocr)", ", ranked as (select *, 1.0 w from visual where query_id // 20 % 4 in (1, 3) union all select *, 4.0 from ocr where query_id // 20 % 4 in (1, 3))") + "select * from fused",
    "query_stages": r""", f as (select segment_id query_id, array_to_string(regexp_extract_all(regexp_replace(text, '[">]', '', 'g'), '\S+'), ' ') free_text from transcript_segment)
select query_id, 0 stage, free_text, 'shop' ocr_phrase, '' asr_phrase, 0::bigint gap_ms from f
union all select query_id, 1, free_text, '', '', 30000 from f where free_text <> ''
union all select query_id, case when free_text = '' then 1 else 2 end, '', '', 'hello there', 60000 from f where free_text is not null""",
    "routed_models": "select query_id, case when query_id // 20 % 3 = 0 then 10 else 1 end model_id from query_vectors",
    "models_with_rows": "select cast(r_regionkey * 5 as integer) model_id from region where r_regionkey * 5 in (select model_id from transcript_embedding)",
    "stage_summary": LINKED + """, n as (select query_id, 0 stage, count(*) hits from hits0 group by query_id union all select query_id, 1, count(*) from hits1 group by query_id), c as (select query_id, count(*) chains from chains group by query_id)
select query_id, stage, case stage when 0 then 'text:"open" the' else 'said:"no way" der' end label, cast(case stage when 1 then 9000 end as bigint) gap_ms, coalesce(hits, 0) hits, coalesce(chains, 0) chains from query_vectors cross join (values (0), (1)) v(stage) left join n using (query_id, stage) left join c using (query_id)""",
    "used_signals": OCR + "select query_id, 's' || query_id // 20 % 2 || ':visual' signal from query_vectors union all select distinct query_id, 's' || query_id // 20 % 2 || ':ocr' from ocr",
    "video_details": "select video_id, collection, 40 as seconds from videos where video_id in (select video_id from keyframes where keyframe_id in (select query_id from query_vectors))",
    "scene_details": "select s.scene_id, s.shot_index, k[cast(floor(len(k) / 2) as integer) + 1] keyframe_id from scenes s join (select scene_id, list(keyframe_id order by ts_ms, keyframe_id) k from keyframes group by scene_id) x using (scene_id) where s.scene_id in (select cast(floor(query_id / 4) as bigint) from query_vectors)",
    "session_list": "select code, count(distinct scene_id) instances, cast(greatest(0, 7200000 - (1706659200000 - cast(floor(epoch_us(max(ts)) / 1000) as bigint))) as bigint) expires_in_ms from submissions group by code",
    "already_submitted": OCR + "select query_id, keyframe_id, exists (select 1 from submissions s where s.status = 'CORRECT' and s.video_id = keyframes.video_id and s.scene_id * 4 + s.event_id % 4 = keyframe_id) submitted from ocr join keyframes using (keyframe_id) where ocr.rank <= 50",
    "stability": FUSED + ", ranked_v as (select *, 1.0 w from visual), sums_v as (select query_id, keyframe_id, scene_id, sum(cast(w as double) / (60 + rank)) score from ranked_v group by all), fused_v as (select query_id, keyframe_id, scene_id, round(score, 6) score, cast(row_number() over (partition by query_id order by round(score, 9) desc, keyframe_id) as integer) rank from sums_v qualify rank <= 48) select 1 run, * from (select * from fused except all select * from fused_v) union all select 2, * from (select * from fused_v except all select * from fused)",
    "caption_vectors": "select keyframe_id, 10 model_id, 64 dims from keyframe_caption where caption <> ''",
    "loaded_vectors": "select vec_id, round(cast(cast(embedding[64] as varchar) as double), 6) last, cast(len(embedding) as integer) dims from embeddings",
    "submission_checks": ", a as (select cast(floor(event_id / 3) as bigint) answer_set, event_id, case when event_type <> 'view' then event_type end media_item, user_id % 2 = 0 collected, case user_id % 3 when 0 then 'said' when 1 then ' ' end said from events qualify row_number() over (partition by cast(floor(event_id / 3) as bigint) order by event_id % 3) = 1), r as (select answer_set, case when media_item is null and said is null then 'no answer' when media_item is not null and not collected then 'no collection' when media_item is null and said = ' ' then 'empty text' else '' end reason from a) select answer_set, reason = '' valid, reason from r",
    "append_new": "select keyframe_id, 1 model_id from keyframes where keyframe_id not in (select vec_id from embeddings)",
    "committed_scenes": "select scene_id, video_id, case when video_id = '00003' then end_ms - 1 when scene_id % 7 = 0 then end_ms + 1 else end_ms end end_ms from scenes where video_id <> '00004' and (video_id <> '00003' or shot_index < 2)",
    "enriched_stream": "select doc_id, case when contains(coalesce(text, ''), '#') then -1 else length(coalesce(text, '')) end chars, case when contains(coalesce(text, ''), '#') then 'sign' else '' end error from (select any_value(text) as text, doc_id from documents where doc_id is not null group by doc_id)",
    "upsert_videos": "select video_id, duration_ms + case when damaged then 1 else 0 end duration_ms, damaged from videos",
    "replace_scenes": "select scene_id, video_id, end_ms from scenes where video_id not in ('00003', '00004') union all select scene_id, video_id, end_ms - 1 from scenes where video_id = '00003' and shot_index < 2",
    "collection_filter": "select keyframe_id, video_id from keyframes join videos using (video_id) where collection = 'V3C1' and video_id <> '00003'",
    "scope_and_shard": "select keyframe_id from keyframes where kf_index = 0 and keyframe_id % 3 = 0",
    "id_contains": "select video_id from videos where contains(video_id, '1')",
    "media_paths": "select keyframe_id, p path, replace(p, 'kf/', 'thumbs/') thumb from (select keyframe_id, 'kf/' || substr(k.video_id, 1, 2) || '/' || k.video_id || '/' || lpad(cast(shot_index as varchar), 5, '0') || '_' || kf_index || '.webp' p from keyframes k join scenes using (scene_id))",
    "segment_scenes": "select segment_id, scene_id from transcript_segment t join scenes s on t.video_id = s.video_id and s.start_ms < t.end_ms and s.end_ms > t.start_ms",
    "pending_vectors": "select keyframe_id, video_id from keyframes where keyframe_id not in (select keyframe_id from keyframe_embedding)",
    "scene_counts": "select video_id, count(scene_id) scenes from videos left join (select * from scenes where scene_id in (select scene_id from embedded)) using (video_id) group by video_id",
    "video_cover": "select v.video_id, c.keyframe_id from videos v left join (select s.video_id, k.keyframe_id from scenes s join embedded k using (scene_id) qualify row_number() over (partition by s.video_id order by shot_index, abs(ts_ms - floor((start_ms + end_ms) / 2)), keyframe_id) = 1) c using (video_id)",
    "filmstrips": "select scene_id, string_agg(cast(keyframe_id as varchar), ',' order by ts_ms, keyframe_id) strip from keyframes group by scene_id",
    "selection_report": "select count(distinct video_id) videos, count(*) scenes, cast(sum(n) as bigint) keyframes, count(*) filter (n < 2) short_scenes, count(*) filter (n = 0) empty_scenes, count(*) filter (blank) blank_scenes, round(avg(n), 6) per_scene from (select s.video_id, s.scene_id, count(k.keyframe_id) n, s.scene_id in (select scene_id from keyframe_caption join keyframes using (keyframe_id) where length(caption) < 200) blank from scenes s left join embedded k using (scene_id) group by all)",
    "keyframe_index": "select keyframe_id, cast(row_number() over (partition by scene_id order by ts_ms, keyframe_id) - 1 as integer) index from keyframes",
    "purge_eligible": "select video_id, exists (select 1 from scenes s where s.video_id = v.video_id) and not exists (select 1 from scenes s where s.video_id = v.video_id and not exists (select 1 from embedded k where k.scene_id = s.scene_id)) candidates, not has_audio or exists (select 1 from transcript_segment t where t.video_id = v.video_id) audio from videos v",
    "knn_hamming": near("", "keyframe_embedding", "keyframe_id", 1000) + "select query_id, keyframe_id, bits from cand",
    "knn_codes": near("", "keyframe_embedding", "keyframe_id", 5) + "select query_id, keyframe_id, bits from cand",
    "knn_rerank": near("", "keyframe_embedding", "keyframe_id", 1000) + "select * from knn",
    "retrieve_ocr": OCR + "select query_id, rank, scene_id, keyframe_id from ocr where rank <= 50",
    "search_two_signal": FUSED + "select * from fused",
    "search_enriched": FUSED + "select query_id, rank, keyframe_id, f.scene_id, k.video_id, shot_index, start_ms, ts_ms, score, cast((select count(*) from keyframes x where x.scene_id = f.scene_id) as integer) strip from fused f join keyframes k using (keyframe_id) join scenes s on s.scene_id = f.scene_id",
    "search_page": FUSED + "select query_id, keyframe_id, score, rank, total, total > 20 has_more from (select *, count(*) over (partition by query_id) total from fused) where rank between 11 and 20",
    "session_fold": RECORDS + "select * from records",
    "session_snapshots": RECORDS + "select code, count(*) instances, count(distinct video_id) distinct_videos, count(distinct case when status in ('CORRECT', 'INDETERMINATE') then video_id end) covered_videos from records group by code",
    "hide_held_sessions": OCR + RECORDS + "select query_id, scene_id, keyframe_id, cast(query_id // 20 % 50 as integer) code from ocr o where rank <= 50 and not exists (select 1 from records r where r.code = query_id // 20 % 50 and r.scene_id = o.scene_id and status in ('CORRECT', 'INDETERMINATE'))",
    "hide_held": OCR + RECORDS + "select query_id, scene_id, keyframe_id from ocr where rank <= 50 and scene_id not in (select scene_id from records where code = 3 and status in ('CORRECT', 'INDETERMINATE'))",
    "job_state": "select video_id, arg_max(stage, struct_pack(ts := ts, event_id := event_id)) stage, count(*) filter (stage = 'FAILED') failures, max(event_id) last_event from job_events group by video_id",
    "query_history": "select user_id, query, cast(rank as integer) rank from (select user_id, event_type query, row_number() over (partition by user_id order by max(ts) desc, event_type) rank from events group by user_id, event_type) where rank <= 3",
}
ORACLES = {name: VIEWS + body for name, body in _BODIES.items()}
