"""DuckDB SQL of the chunkers' walks, stated independently of the plans: lists folded by list_reduce, features by joins."""

from __future__ import annotations

from loomgrain.functions.text import TAG_STOPWORDS
from loomgrain.operators import tfidf
from loomgrain.plans import sqltext as S
from loomgrain.plans import views
from loomgrain.schemas import PROTECTED_TYPES

PROTECTED = "(" + ", ".join(f"'{t}'" for t in PROTECTED_TYPES) + ")"
STOP = ", ".join(f"'{w}'" for w in TAG_STOPWORDS)


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def ordered_distinct(x: str) -> str:
    return let(x, "od", "list_filter(od, lambda ox, oi: list_position(od, ox) = oi)")


#: Both sources as src: doc_id, ord, block_id, type, title, norm.
DOCUMENT_SRC = f"""{views.LINES_SQL},
    src AS MATERIALIZED (SELECT doc_id::VARCHAR AS doc_id, ord, format('{{}}_b{{:05d}}', doc_id, ord) AS block_id, type, source AS title, norm FROM lines)"""
TURN_SRC = f"""
    src AS MATERIALIZED (SELECT 'c' || conv_id AS doc_id, turn AS ord, format('c{{}}_b{{:05d}}', conv_id, turn) AS block_id, 'paragraph' AS type, role AS title, {S.normalize('text')} AS norm
        FROM conversations WHERE {S.normalize('text')} <> '')"""


def windows(text: str, most: int) -> str:
    return let(f"string_split({text}, ' ')", "ws", f"list_transform(range(0, len(ws), {most}), lambda wk: array_to_string(ws[wk + 1 : wk + {most}], ' '))")


def packed(parts: str, most: int, over: str, alone: str = "false") -> str:
    """Greedy groups of parts (list of t, n) as a list of (t, own): own marks a part that is too large; the group before one carries `alone`."""
    join = "CASE WHEN a.held IS NULL THEN p.t ELSE a.held || ' ' || p.t END"
    flush = f"CASE WHEN a.held IS NULL THEN [] ELSE [{{'t': a.held, 'own': false, 'early': {alone}}}] END"
    full = f"a.held IS NOT NULL AND a.total + p.n > {most}"
    step = f"""{{'out': CASE WHEN p.n > {most} THEN list_concat(a.out, list_concat({flush}, {over})) WHEN {full} THEN list_append(a.out, {{'t': a.held, 'own': false, 'early': false}}) ELSE a.out END,
        'held': CASE WHEN p.n > {most} THEN NULL WHEN {full} THEN p.t ELSE {join} END,
        'total': CASE WHEN p.n > {most} THEN 0 WHEN {full} THEN p.n ELSE a.total + p.n END}}"""
    start = "{'out': []::STRUCT(t VARCHAR, own BOOLEAN, early BOOLEAN)[], 'held': NULL::VARCHAR, 'total': 0::BIGINT}"
    done = let(f"list_reduce({parts}, lambda a, p: {step}, {start})", "z", "CASE WHEN z.held IS NULL THEN z.out ELSE list_append(z.out, {'t': z.held, 'own': false, 'early': false}) END")
    return done


def packed_sentences(text: str, most: int) -> str:
    """Texts of at most most tokens from one that is too long: its sentences packed, over-long ones cut into windows."""
    parts = f"list_transform({S.sentences(text)}, lambda s: {{'t': s, 'n': {S.tokens('s')}}})"
    over = f"list_transform({windows('p.t', most)}, lambda w: {{'t': w, 'own': true, 'early': false}})"
    many = f"list_transform({packed(parts, most, over)}, lambda g: g.t)"
    return f"(CASE WHEN len({S.sentences(text)}) <= 1 THEN {windows(text, most)} ELSE {many} END)"


def slim(groups: str, label: str, low: int, high: str) -> str:
    """CTEs ending in done: chunk rows from groups (doc_id, idx, text, ords, extra and what high names)."""
    return f"""
    rowed AS MATERIALIZED (SELECT * REPLACE ({S.normalize('text')} AS text) FROM {groups}),
    memb AS (SELECT m.doc_id, idx, pos, ord, type, title, norm, block_id FROM (SELECT doc_id, idx, unnest(ords) AS ord, generate_subscripts(ords, 1) AS pos FROM rowed) m JOIN src USING (doc_id, ord)),
    kinds AS (SELECT doc_id, idx, list_sort(list(DISTINCT type)) AS types, bool_or(type IN {PROTECTED}) AS prot, {ordered_distinct('list(title ORDER BY pos)')} AS tops,
        list(block_id ORDER BY pos) AS source_blocks FROM memb GROUP BY ALL),
    words AS (SELECT doc_id, idx, w, row_number() OVER (PARTITION BY doc_id, idx ORDER BY pos, j) AS seen FROM
        (SELECT doc_id, idx, pos, unnest(f) AS w, generate_subscripts(f, 1) AS j FROM (SELECT *, regexp_extract_all(lower(norm), '[A-Za-z][A-Za-z0-9_-]{{3,}}') AS f FROM memb)) WHERE w NOT IN ({STOP})),
    common AS (SELECT doc_id, idx, list(w ORDER BY c DESC, p)[1:8] AS ws FROM (SELECT doc_id, idx, w, count(*) AS c, min(seen) AS p FROM words GROUP BY ALL) GROUP BY ALL),
    first_s AS (SELECT *, {S.tokens('text')} AS token_count, string_split(coalesce({S.sentences('text')}[1], ''), ' ') AS sw FROM rowed),
    done AS MATERIALIZED (SELECT format('{{}}_{label}_chunk_{{:05d}}', r.doc_id, idx) AS chunk_id, r.*, source_blocks, tops,
        {ordered_distinct(f'''list_concat(list_concat(list_concat([CASE WHEN token_count < {low} THEN 'short_chunk' WHEN token_count > {high} THEN 'long_chunk' ELSE 'length_ok' END, 'source_anchor_complete'],
            CASE WHEN prot THEN ['protected_block_intact'] ELSE [] END), CASE WHEN len(tops) <= 1 THEN ['title_path_consistent'] ELSE ['mixed_title_paths'] END), extra)''')} AS flags,
        {ordered_distinct("list_concat(list_concat(list_transform(tops[1:4], lambda x: lower(x)), types), coalesce(ws, []))")}[1:8] AS tags,
        CASE WHEN len(sw) <= 48 THEN array_to_string(sw, ' ') ELSE array_to_string(sw[1:48], ' ') || ' ...' END AS summary
        FROM first_s r JOIN kinds USING (doc_id, idx) LEFT JOIN common USING (doc_id, idx))"""


SLIM = "chunk_id, doc_id, token_count, array_to_string(source_blocks, ',') AS source_blocks, array_to_string(flags, ',') AS quality_flags, array_to_string(tags, ',') AS tags, summary"

# ---- fixed ---------------------------------------------------------------------------------

FIXED = f"""WITH RECURSIVE {views.FIXED_SQL},
    src AS MATERIALIZED (SELECT doc_id::VARCHAR AS doc_id, ord, format('{{}}_b{{:05d}}', doc_id, ord) AS block_id, type, source AS title, norm FROM lines),
    fixed_groups AS (SELECT doc_id::VARCHAR AS doc_id, idx, text, ords, list_concat(['fixed_window_baseline'], CASE WHEN cut THEN ['split_long_block'] ELSE [] END) AS extra FROM chunks),
    {slim('fixed_groups', 'fixed', 128, '512')}"""

# ---- recursive -----------------------------------------------------------------------------

_MARK = "CASE lv WHEN 2 THEN '. ' WHEN 3 THEN '; ' WHEN 4 THEN ', ' ELSE ' ' END"
_PARTS = f"""list_transform(list_filter(list_transform(raw, lambda x, i: {S.normalize("x || CASE WHEN i < len(raw) THEN trim(mark) ELSE '' END")}), lambda x: x <> ''), lambda x: {{'t': x, 'n': {S.tokens('x')}}})"""
_CHUNK = "{'t': array_to_string(list_transform(h, lambda x: x.t), ' '), 'ords': list_transform(h, lambda x: x.ord)}"
#: The longest tail that fits the overlap, none if that is all.
_TAIL = let(
    "list_max(list_filter(range(0, len(h) + 1), lambda k: coalesce(list_sum(list_transform(h[len(h) - k + 1 :], lambda x: x.n)), 0) <= 64))", "k", "CASE WHEN k = len(h) THEN h[1:0] ELSE h[len(h) - k + 1 :] END"
)
_SUM = "coalesce(list_sum(list_transform(h, lambda x: x.n)), 0)"
_ON = lambda value, body: let(value, "h", body)
_FULL = f"(len(a.held) > 0 AND {_ON('a.held', _SUM)} + p.n > 512)"
_KEPT = f"CASE WHEN {_FULL} THEN {_ON('a.held', _TAIL)} ELSE a.held END"
_WITH = f"list_append({_KEPT}, p)"
RECURSIVE = f"""WITH RECURSIVE {DOCUMENT_SRC},
    cut AS (
      SELECT doc_id, ord, [0] AS key, norm AS t, 0 AS level, {S.tokens('norm')} <= 512 AS done FROM src
      UNION ALL
      SELECT doc_id, ord, list_append(key, i), g.t, CASE WHEN g.early OR (g.own AND NOT last) THEN lv + 1 ELSE lv END, last OR NOT g.own FROM (
        SELECT doc_id, ord, key, lv, lv > 5 AS last, unnest(groups) AS g, generate_subscripts(groups, 1) AS i FROM (
          SELECT *, CASE WHEN lv > 5 THEN list_transform({windows('t', 512)}, lambda w: {{'t': w, 'own': false, 'early': false}})
              WHEN len(raw) = 1 THEN [{{'t': t, 'own': true, 'early': false}}]
              ELSE {packed(_PARTS, 512, "[{'t': p.t, 'own': true, 'early': false}]", "true")} END AS groups
          FROM (SELECT *, string_split(t, mark) AS raw FROM (SELECT *, {_MARK} AS mark FROM (SELECT doc_id, ord, key, t, greatest(level, 2) AS lv FROM cut WHERE NOT done)))))),
    pieces AS (SELECT doc_id, list({{'t': t, 'ord': ord, 'n': {S.tokens('t')}}} ORDER BY ord, key) AS ps FROM cut WHERE done GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(ps, lambda a, p: {let(_WITH, 'w', f'''{{
          'out': list_concat(list_concat(a.out, CASE WHEN {_FULL} THEN [{_ON('a.held', _CHUNK)}] ELSE [] END), CASE WHEN {_ON('w', _SUM)} >= 512 THEN [{_ON('w', _CHUNK)}] ELSE [] END),
          'held': CASE WHEN {_ON('w', _SUM)} >= 512 THEN {_ON('w', _TAIL)} ELSE w END}}''')},
        {{'out': []::STRUCT(t VARCHAR, ords BIGINT[])[], 'held': []::STRUCT(t VARCHAR, ord BIGINT, n BIGINT)[]}}) AS z FROM pieces),
    listed AS (SELECT doc_id, CASE WHEN len(z.held) > 0 THEN list_append(z.out, {_ON('z.held', _CHUNK)}) ELSE z.out END AS cs FROM folded),
    recursive_groups AS (SELECT doc_id, idx, c.t AS text, {ordered_distinct('c.ords')} AS ords, ['recursive_baseline'] AS extra
        FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS idx FROM listed)),
    {slim('recursive_groups', 'recursive', 128, '512')}"""

# ---- semantic ------------------------------------------------------------------------------

UNITS = rf"""
    cut AS (SELECT doc_id, ord, CASE WHEN type IN {PROTECTED} THEN [norm] ELSE list_filter(list_transform(string_split(regexp_replace(norm, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') END AS s FROM src),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, sentence) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM
        (SELECT doc_id, ord, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS sentence FROM cut)),
    every_tf AS MATERIALIZED (SELECT doc_id, place, term, count(*) AS tf FROM (SELECT doc_id, place, unnest(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_\-'']*'), lambda t: regexp_replace(t, '[-'']+$', ''))) AS term FROM placed)
           WHERE regexp_matches(term, '^[a-z][a-z0-9_\-'']+$') AND term NOT IN ({", ".join(f"'{w}'" for w in tfidf.STOP)}) GROUP BY ALL),
    kept AS (SELECT doc_id, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY sum(tf) DESC, term) AS r FROM every_tf GROUP BY doc_id, term) WHERE r <= 5000),
    tf AS MATERIALIZED (SELECT every_tf.* FROM every_tf JOIN kept USING (doc_id, term)),
    df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
    heavy AS (SELECT tf.doc_id, tf.place, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, term) JOIN (SELECT DISTINCT doc_id, n FROM placed) USING (doc_id)),
    weighted AS (SELECT doc_id, place, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, place)) AS w FROM heavy),
    near AS (SELECT a.doc_id, a.place, sum(a.w * b.w) AS s FROM weighted a JOIN weighted b ON a.doc_id = b.doc_id AND a.term = b.term AND b.place = a.place + 1 GROUP BY ALL),
    distances AS (SELECT p.doc_id, p.place, round(1.0 - coalesce(s, 0.0), 9) AS distance FROM placed p LEFT JOIN near USING (doc_id, place) WHERE p.place < p.n),
    limits AS (SELECT doc_id, quantile_cont(distance, 0.75) AS lim FROM distances WHERE doc_id IN (SELECT doc_id FROM tf) GROUP BY doc_id),
    units AS (SELECT p.doc_id, list({{'t': text, 'ord': ord, 'n': {S.tokens('text')}, 'brk': coalesce(p.n >= 3 AND distance >= lim, false)}} ORDER BY p.place) AS us
        FROM placed p LEFT JOIN distances USING (doc_id, place) LEFT JOIN limits USING (doc_id) GROUP BY p.doc_id)"""
_FLAGGED = lambda flags: "{'t': array_to_string(list_transform(h, lambda x: x.t), ' '), 'ords': list_transform(h, lambda x: x.ord), 'flags': " + flags + "}"
_PRE = f"(len(a.held) > 0 AND (p.n > 768 OR {_ON('a.held', _SUM)} + p.n > 768))"
_TARGET = f"({_ON('w', _SUM)} >= 512 OR (p.brk AND {_ON('w', _SUM)} >= 160))"
_WHY = f"CASE WHEN p.brk AND {_SUM} >= 160 THEN ['semantic_boundary', 'semantic_baseline'] ELSE ['target_length_boundary', 'semantic_baseline'] END"
SEMANTIC = f"""WITH RECURSIVE {DOCUMENT_SRC}, {UNITS},
    folded AS (SELECT doc_id, list_reduce(us, lambda a, p: {let(f"CASE WHEN p.n > 768 THEN us[1:0] WHEN {_PRE} THEN [p] ELSE list_append(a.held, p) END", 'w', f'''{{
          'out': list_concat(list_concat(a.out, CASE WHEN {_PRE} THEN [{_ON('a.held', _FLAGGED("CASE WHEN p.n > 768 THEN ['semantic_baseline'] ELSE ['max_length_boundary', 'semantic_baseline'] END"))}] ELSE [] END),
              CASE WHEN p.n > 768 THEN list_transform({packed_sentences('p.t', 768)}, lambda x: {{'t': x, 'ords': [p.ord], 'flags': ['semantic_baseline', 'split_long_unit']}})
                   WHEN {_TARGET} THEN [{_ON('w', _FLAGGED(_WHY))}] ELSE [] END),
          'held': CASE WHEN p.n > 768 OR {_TARGET} THEN us[1:0] ELSE w END}}''')},
        {{'out': []::STRUCT(t VARCHAR, ords BIGINT[], flags VARCHAR[])[], 'held': us[1:0]}}) AS z FROM units),
    listed AS (SELECT doc_id, CASE WHEN len(z.held) > 0 THEN list_append(z.out, {_ON('z.held', _FLAGGED("['final_flush', 'semantic_baseline']"))}) ELSE z.out END AS cs FROM folded),
    semantic_groups AS (SELECT doc_id, idx, c.t AS text, {ordered_distinct('c.ords')} AS ords, c.flags AS extra FROM (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS idx FROM listed)),
    {slim('semantic_groups', 'semantic', 160, '768')}"""

# ---- structure -----------------------------------------------------------------------------

PROFILE = f"""
    blocks AS MATERIALIZED (SELECT *, {S.tokens('t')} AS size, {S.bag('t')} AS bag, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM
        (SELECT *, CASE WHEN contains(lower(left(norm, 120)), lower(title)) THEN norm ELSE '[' || title || '] ' || norm END AS t FROM src)),
    counts AS MATERIALIZED (SELECT doc_id, i, w, count(*) AS n FROM (SELECT doc_id, i, unnest(bag) AS w FROM blocks) GROUP BY ALL),
    norms AS (SELECT doc_id, i, sqrt(sum(n * n)) AS l FROM counts GROUP BY ALL),
    tails AS MATERIALIZED (SELECT b.doc_id, b.i, k, w, sum(n) AS n FROM blocks b CROSS JOIN (VALUES (1), (2), (3)) t(k) JOIN counts c ON c.doc_id = b.doc_id AND c.i BETWEEN b.i - k AND b.i - 1 WHERE b.i > k GROUP BY ALL),
    tail_norms AS (SELECT doc_id, i, k, sqrt(sum(n * n)) AS l FROM tails GROUP BY ALL),
    dots AS (SELECT t.doc_id, t.i, k, sum(t.n * c.n) AS dot FROM tails t JOIN counts c USING (doc_id, i, w) GROUP BY ALL),
    sims AS MATERIALIZED (SELECT b.doc_id, b.i, t.k, round(least(1.0, coalesce(dot / (x.l * y.l), 0.0)), 4) AS s FROM blocks b CROSS JOIN (VALUES (1), (2), (3)) t(k)
        LEFT JOIN dots d ON d.doc_id = b.doc_id AND d.i = b.i AND d.k = t.k LEFT JOIN tail_norms x ON x.doc_id = b.doc_id AND x.i = b.i AND x.k = t.k
        LEFT JOIN norms y ON y.doc_id = b.doc_id AND y.i = b.i WHERE b.i > t.k),
    per AS (SELECT doc_id, count(*) AS block_count, round(round(avg(size), 9), 4) AS avg_tokens, round(avg(CASE WHEN size < 180 THEN 1.0 ELSE 0.0 END), 4) AS short_rate,
        round(avg(CASE WHEN size < 256 THEN 1.0 ELSE 0.0 END), 4) AS half_rate, round(avg(CASE WHEN type IN {PROTECTED} THEN 1.0 ELSE 0.0 END), 4) AS prot_rate FROM blocks GROUP BY doc_id),
    moves AS (SELECT doc_id, coalesce(round(avg(CASE WHEN moved THEN 1.0 ELSE 0.0 END) FILTER (i > 1), 4), 0.0) AS rate
        FROM (SELECT doc_id, i, title <> lag(title) OVER (PARTITION BY doc_id ORDER BY i) AS moved FROM blocks) GROUP BY doc_id),
    dist AS (SELECT doc_id, round(round(avg(round(1 - s, 4)), 9), 4) AS mean, list_sort(list(round(1 - s, 4))) AS ds FROM sims WHERE k = 1 GROUP BY doc_id),
    stat AS (SELECT p.doc_id, block_count, avg_tokens, short_rate, half_rate, prot_rate, rate, coalesce(mean, 0.0) AS mean,
        coalesce(ds[1 + CAST(round_even((len(ds) - 1) * 0.75, 0) AS BIGINT)], 0.0) AS p75 FROM per p JOIN moves USING (doc_id) LEFT JOIN dist USING (doc_id)),
    needs AS (SELECT *, round(round(least(1.0, 0.30 * short_rate + 0.22 * half_rate + 0.20 * least(1.0, block_count / 80) + 0.18 * round(greatest(0.0, 1.0 - mean), 4) + 0.10 * prot_rate), 9), 4) AS ctx,
        round(round(least(1.0, 0.60 * rate + 0.24 * mean + 0.10 * p75 + 0.06 * prot_rate), 9), 4) AS str FROM stat),
    chosen AS (SELECT *, CASE WHEN (str >= 0.62 OR rate >= 0.20 OR (rate >= 0.42 AND mean >= 0.58)) AND round(ctx - str, 4) < 0.24 THEN 'structure_preserving'
        WHEN avg_tokens <= 512 * 0.45 AND round(ctx - str, 4) >= 0.34 AND str < 0.54 THEN 'high_context_coverage'
        WHEN round(ctx - str, 4) >= 0.18 AND str < 0.62 THEN 'context_coverage' ELSE 'balanced' END AS profile FROM needs),
    limits AS (SELECT doc_id, target, hard::DOUBLE AS hard, soft::DOUBLE AS soft, far::DOUBLE AS far FROM chosen JOIN
        (VALUES ('structure_preserving', 512, 0.60, 0.50, 0.70), ('high_context_coverage', 716, 0.86, 0.76, 0.92), ('context_coverage', 640, 0.76, 0.66, 0.84), ('balanced', 512, 0.62, 0.52, 0.72))
        t(profile, target, hard, soft, far) USING (profile))"""
_NULL_D = "NULL::STRUCT(reason VARCHAR, score DOUBLE, similarity DOUBLE, distance DOUBLE, triggered BOOLEAN)"
_ROW = lambda text, ords, titles, flags, most, decision: f"{{'t': {text}, 'ords': {ords}, 'titles': {titles}, 'flags': {flags}, 'most': {most}, 'd': {decision}}}"
_HELD_ROW = lambda flags, decision: _ROW("array_to_string(list_transform(h, lambda x: x.t), ' ')", "list_transform(h, lambda x: x.ord)", "list_transform(h, lambda x: x.title)", flags, "900::BIGINT", decision)
_DECIDED = let(  # the decision before block p, or null: o holds the tokens so far and what was measured
    f"{{'n': {_ON('a.held', _SUM)}, 'near': CASE WHEN len(a.held) >= 3 THEN p.s3 WHEN len(a.held) = 2 THEN p.s2 ELSE p.s1 END, 'last': a.held[len(a.held)]}}",
    "m",
    let(
        """{'n': m.n, 'near': m.near, 'distance': round(1.0 - m.near, 4), 'pressure': round(least(1.0, m.n / greatest(1, target)), 4), 'moved': m.last.title <> p.title,
        'signal': CASE WHEN m.last.title <> p.title THEN 1.0 WHEN p.prot THEN 0.45 WHEN m.last.type <> p.type THEN 0.25 ELSE 0.0 END}""",
        "o",
        let(
            "round(0.45 * o.signal + 0.35 * o.distance + 0.20 * o.pressure, 4)",
            "sc",
            let(
                """CASE WHEN o.n + p.n > 900 THEN 'max_length_boundary' WHEN o.distance >= far AND o.n >= 180 AND o.pressure >= 0.65 THEN 'semantic_boundary'
                WHEN o.moved AND o.n >= 180 AND sc >= soft THEN 'section_boundary_respected' WHEN o.n >= 180 AND sc >= hard THEN 'scored_structure_semantic_boundary'
                WHEN o.n >= target AND sc >= soft THEN 'target_length_boundary' END""",
                "why",
                "CASE WHEN why IS NULL THEN NULL ELSE {'reason': why, 'score': sc::DOUBLE, 'similarity': o.near::DOUBLE, 'distance': o.distance::DOUBLE, 'triggered': o.distance >= far AND o.n >= 180 AND o.pressure >= 0.65} END",
            ),
        ),
    ),
)
_MORE = "CASE WHEN d.triggered THEN ['semantic_boundary'] WHEN d.distance >= far THEN ['semantic_shift_observed'] ELSE [] END"
_CLOSED = f"list_concat(list_concat([d.reason, 'structure_adaptive_boundary', 'structure_boundary_scored'], {_MORE}), ['structure_aware'])"
_OVERSIZE = f"""CASE WHEN p.prot THEN [{_ROW('p.t', '[p.ord]', '[p.title]', "['structure_aware', 'protected_block_over_target', 'kept_protected_block_intact', 'structure_adaptive_boundary']", 'p.n', _NULL_D)}]
    ELSE list_transform({packed_sentences('p.t', 900)}, lambda x: {_ROW('x', '[p.ord]', '[p.title]', "['structure_aware', 'split_long_text_by_sentence', 'structure_adaptive_boundary']", '900::BIGINT', _NULL_D)}) END"""
_PLAIN = _ON("a.held", _HELD_ROW("['structure_adaptive_boundary', 'structure_aware']", _NULL_D))
_ROW_TYPE = "STRUCT(t VARCHAR, ords BIGINT[], titles VARCHAR[], flags VARCHAR[], most BIGINT, d STRUCT(reason VARCHAR, score DOUBLE, similarity DOUBLE, distance DOUBLE, triggered BOOLEAN))[]"


def structure(source: str) -> str:
    """CTEs ending in merged: the structure-aware chunks of src."""
    step = let(
        f"CASE WHEN len(a.held) > 0 AND p.n <= 900 THEN {_DECIDED} END",
        "d",
        f"""{{'out': CASE WHEN p.n > 900 THEN list_concat(list_concat(a.out, CASE WHEN len(a.held) > 0 THEN [{_PLAIN}] ELSE [] END), {_OVERSIZE})
                WHEN d IS NOT NULL THEN list_append(a.out, {_ON('a.held', _HELD_ROW(_CLOSED, 'd'))}) ELSE a.out END,
            'held': CASE WHEN p.n > 900 THEN bs[1:0] WHEN d IS NOT NULL THEN [p] ELSE list_append(a.held, p) END}}""",
    )
    size = lambda x: S.tokens(S.normalize(x))
    final = _ON("z.held", _HELD_ROW("['final_flush', 'structure_adaptive_boundary', 'structure_aware']", _NULL_D))
    return f"""WITH RECURSIVE {source}, {PROFILE},
    walked AS (SELECT doc_id, any_value(target) AS target, any_value(hard) AS hard, any_value(soft) AS soft, any_value(far) AS far,
        list({{'t': t, 'ord': ord, 'n': size, 'title': title, 'type': type, 'prot': type IN {PROTECTED}, 's1': s1.s, 's2': s2.s, 's3': s3.s}} ORDER BY blocks.i) AS bs FROM blocks JOIN limits USING (doc_id)
        LEFT JOIN (FROM sims WHERE k = 1) s1 USING (doc_id, i) LEFT JOIN (FROM sims WHERE k = 2) s2 USING (doc_id, i) LEFT JOIN (FROM sims WHERE k = 3) s3 USING (doc_id, i) GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(bs, lambda a, p: {step}, {{'out': []::{_ROW_TYPE}, 'held': bs[1:0]}}) AS z FROM walked),
    listed AS (SELECT doc_id, CASE WHEN len(z.held) > 0 THEN list_append(z.out, {final}) ELSE z.out END AS cs FROM folded),
    paired AS (SELECT doc_id, cs, list_reduce(range(1, len(cs) + 1), lambda a, i: {let(f'''i > 1 AND a.free AND {size('cs[i - 1].t')} < 180 AND {size('cs[i - 1].t')} + {size('cs[i].t')} <= 900 AND cs[i - 1].titles[1] = cs[i].titles[1]''', 'j',
        "{'pairs': list_append(a.pairs, CASE WHEN j THEN a.pairs[len(a.pairs)] ELSE coalesce(a.pairs[len(a.pairs)], 0) + 1 END), 'free': NOT j}")}, {{'pairs': []::BIGINT[], 'free': true}}) AS y FROM listed),
    structure_groups AS (SELECT doc_id, i AS idx, cs[i].t AS text, {ordered_distinct('cs[i].ords')} AS ords, cs[i].flags AS extra, cs[i].most AS most, cs[i].d AS d, y.pairs[i] AS pair
        FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM paired)),
    {slim('structure_groups', 'structure', 180, 'most')},
    gathered AS (SELECT doc_id, pair, list(text ORDER BY idx) AS texts, list(source_blocks ORDER BY idx) AS sb, list(flags ORDER BY idx) AS fl, list(tags ORDER BY idx) AS tg, first(summary ORDER BY idx) AS summary,
        list(token_count ORDER BY idx) AS ns, first(d ORDER BY idx) AS d FROM done GROUP BY doc_id, pair),
    merged AS (SELECT format('{{}}_structure_chunk_{{:05d}}', doc_id, pair) AS chunk_id, doc_id, CASE WHEN len(ns) = 2 THEN {S.tokens("array_to_string(texts, chr(10) || chr(10))")} ELSE ns[1] END AS token_count,
        {ordered_distinct('flatten(sb)')} AS source_blocks, CASE WHEN len(ns) = 2 THEN {ordered_distinct("list_append(flatten(fl), 'merged_short_chunk')")} ELSE fl[1] END AS flags,
        CASE WHEN len(ns) = 2 THEN {ordered_distinct('flatten(tg)')}[1:10] ELSE tg[1] END AS tags, summary, d FROM gathered)"""
