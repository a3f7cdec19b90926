"""The registered queries as plain SQL (DuckDB dialect), from the definitions.

Common table expressions stand for the stages; a query names the ones it
needs.  Where a rule allows it the SQL takes another route than the engine:
coverage counts positions, flanks compare character by character.
"""

from __future__ import annotations

import re

from catalog import fixtures as fx

# Nucleotide codes and complements, as in the engine's contract.
CODES, COMPLEMENTS = "ATUGCYRSWKMBDHVN-~", "TAACGRYSWMKVHDBN-~"


def _strands(reads: str, both: bool = True) -> str:
    forward = f"SELECT q, '+' AS strand, seq FROM {reads}"
    if not both:
        return forward
    return f"{forward} UNION ALL SELECT q, '-', reverse(translate(seq, '{CODES}', '{COMPLEMENTS}')) FROM {reads}"


def _seeds(strands: str, t: int) -> str:
    step, k = t // 2, t - t // 2 + 1
    return f"""SELECT q, strand, CAST(qpos AS BIGINT) AS qpos, substr(seq, qpos + 1, {k}) AS kmer FROM (
      SELECT q, strand, seq, unnest(range(0, length(seq) - {t}, {step})) AS qpos FROM {strands} WHERE length(seq) > {t})"""


def _postings(refs: str, t: int, skip_n: bool = True) -> str:
    # Long texts are cut into overlapping windows first, only for speed.
    k = t - t // 2 + 1
    return f"""SELECT db_id, ref_id, CAST(w * 512 + i AS BIGINT) AS rpos, kmer FROM (
      SELECT db_id, ref_id, w, i, substr(piece, i + 1, {k}) AS kmer FROM (
        SELECT db_id, ref_id, w, piece, unnest(range(0, length(piece) - {k} + 1)) AS i FROM (
          SELECT db_id, ref_id, w, substr(seq, w * 512 + 1, {512 + k - 1}) AS piece FROM (
            SELECT CAST(db_id AS BIGINT) AS db_id, ref_id, seq, unnest(range(0, (length(seq) + 511) // 512)) AS w
            FROM {refs}))))
      {f"WHERE kmer <> repeat('N', {k})" if skip_n else ""}"""


def _hits(seeds: str, postings: str) -> str:
    return f"""SELECT q, strand, db_id, ref_id, qpos, rpos FROM {seeds} JOIN {postings} USING (kmer)"""


def _streaks(hits: str) -> str:
    return f"""
    SELECT q, strand, db_id, ref_id, max(n) AS streak FROM (
      SELECT q, strand, db_id, ref_id, island, count(*) AS n FROM (
        SELECT *, no - row_number() OVER (PARTITION BY q, strand, db_id, ref_id ORDER BY no) AS island FROM (
          SELECT DISTINCT q, strand, db_id, ref_id, no FROM (
            SELECT *, dense_rank() OVER (PARTITION BY q, strand, db_id ORDER BY qpos) AS no FROM {hits})))
      GROUP BY ALL)
    GROUP BY ALL"""


def _near_best(hits: str) -> str:
    """Hits of references within one seed of the best streak."""
    return f"""
    SELECT h.* FROM {hits} h SEMI JOIN (
      SELECT * FROM (SELECT *, max(streak) OVER (PARTITION BY q, strand, db_id) AS best FROM ({_streaks(hits)}))
      WHERE streak >= greatest(1, best - 1)) s USING (q, strand, db_id, ref_id)"""


def _runs(hits: str, step: int, diagonal: bool = False) -> str:
    if diagonal:
        part, order = "q, strand, db_id, ref_id, rpos - qpos", "qpos"
    else:
        part, order = "q, strand, db_id, ref_id", "rpos, qpos"
    extra = ", rpos - qpos AS d" if diagonal else ", 0 AS d"
    return f"""
    SELECT q, strand, db_id, ref_id, count(*) AS n_seeds, min(qpos) AS q_start, min(rpos) AS r_start,
           max(qpos) + {step} AS q_end, max(rpos) + {step} AS r_end FROM (
      SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY {order}) AS run FROM (
        SELECT *{extra}, coalesce(lag(rpos) OVER w = rpos - {step} AND lag(qpos) OVER w = qpos - {step}, false) AS linked
        FROM {hits} WINDOW w AS (PARTITION BY {part} ORDER BY {order})))
    GROUP BY q, strand, db_id, ref_id, d, run"""


def _tied_longest(runs: str) -> str:
    return f"""
    SELECT q, strand, db_id, ref_id, n_seeds, q_start, r_start, q_end, r_end FROM (
      SELECT *, max(n_seeds) OVER (PARTITION BY q, strand) AS best,
             max(n_seeds) OVER (PARTITION BY q, strand, db_id, ref_id) AS longest FROM {runs})
    WHERE best >= 2 AND longest = best"""


def _common(n: str, left: str, right: str) -> str:
    at = f"list_position(list_transform(range(1, {n} + 1), lambda i: {left} = {right}), false)"
    return f"CASE WHEN {n} <= 0 THEN 0 WHEN coalesce({at}, 0) = 0 THEN {n} ELSE {at} - 1 END"


def _segments(runs: str, strands: str, refs: str, t: int, extend: bool = True) -> str:
    if extend:
        head = _common("head_room", "substr(qh, head_room - i + 1, 1)", "substr(rh, head_room - i + 1, 1)")
        tail = _common("tail_room", "substr(qt, i, 1)", "substr(rt, i, 1)")
    else:
        head = tail = "0"
    return f"""
    SELECT *, n_head + n_mid + n_tail AS m FROM (
      SELECT q, strand, db_id, ref_id, n_seeds, q_start, r_start, q_end, r_end, query_len, ref_len,
             CAST({head} AS BIGINT) AS n_head, q_end - q_start AS n_mid, CAST({tail} AS BIGINT) AS n_tail
      FROM (SELECT u.*, length(s.seq) AS query_len, length(f.seq) AS ref_len,
                   least({t}, u.q_start, u.r_start) AS head_room,
                   least({t}, length(s.seq) - u.q_end, length(f.seq) - u.r_end) AS tail_room,
                   substr(s.seq, u.q_start - head_room + 1, head_room) AS qh,
                   substr(f.seq, u.r_start - head_room + 1, head_room) AS rh,
                   substr(s.seq, u.q_end + 1, {t}) AS qt, substr(f.seq, u.r_end + 1, {t}) AS rt
            FROM {runs} u JOIN {strands} s USING (q, strand) JOIN {refs} f USING (ref_id)))"""


def _covered_by_position(segments: str, t: int) -> str:
    return f"""
    SELECT q, strand, db_id, ref_id, count(DISTINCT pos) AS covered FROM (
      SELECT q, strand, db_id, ref_id, unnest(range(q_start - n_head, q_start - n_head + m)) AS pos
      FROM {segments} WHERE m >= {t}) GROUP BY ALL"""


def _scores(segments: str, t: int) -> str:
    return f"""
    SELECT *, ln(raw + 1) / ln((least(query_len, ref_len) + 1) / 2.0 + 1) AS score FROM (
      SELECT *, CAST(sum_sq AS DOUBLE) / considered / 100 * pct AS raw FROM (
        SELECT *, 100.0 * covered / query_len AS pct FROM (
          SELECT q, strand, db_id, ref_id, query_len, ref_len, CAST(sum(m * (m + 1) // 2) AS BIGINT) AS sum_sq,
                 CAST(sum(m) AS BIGINT) AS considered FROM {segments} WHERE m >= {t} GROUP BY ALL)
        JOIN ({_covered_by_position(segments, t)}) USING (q, strand, db_id, ref_id)))"""


def _better_strand(scores: str) -> str:
    return f"""
    SELECT s.* FROM {scores} s JOIN (
      SELECT q, strand FROM (
        SELECT q, strand, row_number() OVER (PARTITION BY q ORDER BY max(round(score, 6)) DESC, strand) AS place
        FROM {scores} WHERE score > 0 GROUP BY q, strand) WHERE place = 1) USING (q, strand)"""


def _groups(scores: str) -> str:
    return f"""
    SELECT q, ref_id, round(score, 6) AS confident,
           dense_rank() OVER (PARTITION BY q ORDER BY round(score, 6) DESC) AS grp FROM ({_better_strand(scores)})"""


def _members(groups: str, refs: str, top: bool = True) -> str:
    where = "WHERE grp = 1" if top else ""
    return f"""SELECT q, grp, confident, ref_id, header, CAST(tax_id AS BIGINT) AS tax_id
    FROM {groups} JOIN {refs} USING (ref_id) {where}"""


def _occurrences(members: str) -> str:
    return f"SELECT q, grp, confident, tax_id, count(*) AS n FROM {members} GROUP BY ALL"


def _winners(occurrences: str) -> str:
    return f"""
    SELECT q, grp, confident, tax_id, n, ord FROM (
      SELECT *, sum(CASE WHEN n <> first THEN 1 ELSE 0 END) OVER (PARTITION BY q, grp ORDER BY ord) AS off FROM (
        SELECT *, row_number() OVER w AS ord, first_value(n) OVER w AS first FROM {occurrences}
        WINDOW w AS (PARTITION BY q, grp ORDER BY tax_id <> -1, n DESC, tax_id)))
    WHERE off = 0"""


def _results(members: str, winners: str, reads: str) -> str:
    return f"""
    SELECT q, r.header AS query_header, confident, tax_ids, occurrences, headers, grp FROM (
      SELECT q, grp, confident, string_agg(CAST(tax_id AS STRING), ',' ORDER BY ord) AS tax_ids,
             string_agg(CAST(n AS STRING), ',' ORDER BY ord) AS occurrences FROM {winners} GROUP BY q, grp, confident)
    JOIN (SELECT q, grp, string_agg(m.header, ',' ORDER BY ord, ref_id) AS headers
          FROM {members} m JOIN {winners} w USING (q, grp, tax_id) GROUP BY q, grp) USING (q, grp)
    JOIN {reads} r USING (q)"""


def _fnv(kmer: str, k: int) -> str:
    h = "CAST(2166136261 AS BIGINT)"
    for i in range(1, k + 1):
        h = f"xor(({h} * 16777619) & 4294967295, CAST(ascii(substr({kmer}, {i}, 1)) AS BIGINT))"
    return h


def _fold(bits: int) -> str:
    return f"xor(h32 >> {bits}, h32) & {(1 << bits) - 1}"


def _sampled(postings: str, k: int, pct: int) -> str:
    return f"SELECT * FROM (SELECT *, {_fnv('kmer', k)} AS h32 FROM ({postings})) WHERE ({_fold(28)}) % 100 < {pct}"


def _chain(
    prefix: str, refs: str, reads: str, t: int, both: bool, extend: bool = True, top: bool = True, pct: int = 100
) -> dict[str, str]:
    """The stages of one classification under names with a common prefix."""
    p = prefix
    postings = _postings(f"{p}_refs", t)
    return {
        f"{p}_refs": refs,
        f"{p}_reads": reads,
        f"{p}_strands": _strands(f"{p}_reads", both),
        f"{p}_seeds": _seeds(f"{p}_strands", t),
        f"{p}_postings": postings if pct == 100 else _sampled(postings, t - t // 2 + 1, pct),
        f"{p}_hits": _hits(f"{p}_seeds", f"{p}_postings"),
        f"{p}_near": _near_best(f"{p}_hits"),
        f"{p}_runs": _runs(f"{p}_hits", t // 2),
        f"{p}_near_runs": _runs(f"{p}_near", t // 2),
        f"{p}_candidates": _tied_longest(f"{p}_near_runs"),
        f"{p}_segments": _segments(f"{p}_candidates", f"{p}_strands", f"{p}_refs", t, extend),
        f"{p}_scores": _scores(f"{p}_segments", t),
        f"{p}_groups": _groups(f"{p}_scores"),
        f"{p}_members": _members(f"{p}_groups", f"{p}_refs", top),
        f"{p}_occurrences": _occurrences(f"{p}_members"),
        f"{p}_winners": _winners(f"{p}_occurrences"),
        f"{p}_results": _results(f"{p}_members", f"{p}_winners", f"{p}_reads"),
    }


T = fx.THRESHOLD
K = T - T // 2 + 1
STAGES: dict[str, str] = {
    "dna_raw": fx.DNA_READS_RAW,
    **_chain("dna", fx.DNA_REFS, "SELECT q, header, upper(seq) AS seq FROM dna_raw", T, both=True),
    **_chain("all", "SELECT * FROM dna_refs", "SELECT * FROM dna_reads", T, both=True, top=False),
    **_chain("quick", "SELECT * FROM dna_refs", "SELECT * FROM dna_reads", T, both=True, extend=False),
    **_chain("text", fx.TEXT_REFS, fx.TEXT_READS, T, both=False),
    "document_texts": f"""SELECT doc_id AS seq_id, '>' || CAST(doc_id AS STRING) AS header,
                          {fx.upper_ascii('text')} AS seq FROM documents""",
    "document_strands": "SELECT seq_id AS q, '+' AS strand, seq FROM document_texts",
    "self_seeds": _seeds("document_strands", T),
    "self_hits": _hits("self_seeds", "text_postings"),
    "self_near": _near_best("self_hits"),
    "self_runs": _runs("self_hits", T // 2),
    "self_near_runs": _runs("self_near", T // 2),
    "self_candidates": _tied_longest("self_near_runs"),
    "two_db_hits": "SELECT q, strand, ref_id % 2 AS db_id, ref_id, qpos, rpos FROM dna_hits",
    "accessions": """SELECT 'AC' || CAST(ref_id AS STRING) || '.1' AS accession, CAST(tax_id AS BIGINT) AS tax_id
                     FROM dna_refs""",
    "header_names": """SELECT '>AC' || CAST(p_partkey AS STRING) || '.1 synthetic' AS old,
                       '>named;' || p_name || ';' || CAST(p_partkey AS STRING) AS new FROM part""",
    "two_db_near": _near_best("two_db_hits"),
    "two_db_runs": _runs("two_db_near", T // 2),
    "two_db_candidates": _tied_longest("two_db_runs"),
    "two_db_segments": _segments("two_db_candidates", "dna_strands", "(SELECT * EXCLUDE (db_id) FROM dna_refs)", T),
    "two_db_scores": _scores("two_db_segments", T),
    "two_db_groups": _groups("two_db_scores"),
    "two_db_members": _members("two_db_groups", "dna_refs"),
    "cut_texts": """SELECT db_id, ref_id * 10 + chunk AS ref_id, header, substr(seq, chunk * 128 + 1, 128) AS seq, tax_id
                    FROM (SELECT *, unnest(range(0, (length(seq) + 127) // 128)) AS chunk FROM dna_refs)""",
    **_chain("cut", "SELECT * FROM cut_texts", "SELECT * FROM dna_reads", T, both=True),
    **_chain("kin", fx.kin_refs("dna_refs"), "SELECT * FROM dna_reads", T, both=True, top=False),
    **_chain("copied", "SELECT * FROM kin_refs", fx.copied_reads("dna_reads"), T, both=True, top=False),
    **_chain("thin", "SELECT * FROM dna_refs", "SELECT * FROM dna_reads", T, both=True, pct=60),
    "thin_unextended": _segments("thin_candidates", "thin_strands", "thin_refs", T, extend=False),
    "kin_parts": """SELECT *, (row_number() OVER (PARTITION BY q, grp ORDER BY ord, ref_id) - 1) // 2 AS part_no
                    FROM kin_members JOIN (SELECT q, grp, tax_id, ord FROM kin_winners) USING (q, grp, tax_id)""",
    "kin_lines": """SELECT *, (row_number() OVER (PARTITION BY q, grp ORDER BY ref_id) - 1) // 2 AS part_no FROM kin_members""",
    **_chain("short", "SELECT * FROM dna_refs", "SELECT * FROM dna_reads", 18, both=True),
}


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [name for name in STAGES if name in words]


def with_stages(sql: str) -> str:
    """Prefix ``sql`` with the stages it names, directly or through others."""
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _uses(STAGES[name]) if n != name]
    ordered = [n for n in STAGES if n in needed]
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({STAGES[n]})" for n in ordered) + "\n" + sql


PAIR = "q, strand, db_id, ref_id"
RUN = f"{PAIR}, n_seeds, q_start, r_start, q_end, r_end"
RESULT = "q, query_header, confident, tax_ids, occurrences, headers, grp"
PROFILE = """SELECT db_id, ref_id, count(*) AS n, CAST(sum(rpos) AS BIGINT) AS rpos_sum, min(kmer) AS min_kmer,
             max(kmer) AS max_kmer FROM {} GROUP BY db_id, ref_id"""
FILE_COLUMNS = """q AS InputID, query_header AS InputSequence, printf('%.6f', confident) AS Confident, tax_ids AS TaxIDs,
                  occurrences AS Occurence_Per_TaxID, headers AS Headers"""


def _tier_rows(columns: str) -> str:
    levels = [("raw", -1.0), ("high_sensitivity", 0.4), ("balanced", 0.7), ("high_precision", 1.0)]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS tier, {columns} FROM dna_results WHERE confident >= {low}" for name, low in levels
    )


def _suppressed(postings: str, cap: int = 20) -> str:
    return f"""
    SELECT * FROM {postings} WHERE kmer IN (
      SELECT kmer FROM (SELECT kmer, count(*) AS n FROM {postings} GROUP BY kmer) WHERE n <= (
        SELECT least({cap}, n) FROM (
          SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total
          FROM (SELECT count(*) AS n FROM {postings} GROUP BY kmer)) WHERE i = floor(total * 0.30)))"""


def _pair_profile(rows: str, at_query: str, at_ref: str) -> str:
    return f"""SELECT q, ref_id, count(*) AS n, CAST(sum({at_query}) AS BIGINT) AS q_sum,
        CAST(sum({at_query} * {at_ref}) AS BIGINT) AS qr_sum FROM {rows} GROUP BY q, ref_id"""


FLANKS = f"""SELECT q, strand, ref_id, q_start, r_start,
        substr(s.seq, greatest(0, q_start - {T}) + 1, least({T}, q_start)) AS q_head,
        substr(f.seq, greatest(0, r_start - {T}) + 1, least({T}, r_start)) AS r_head,
        substr(s.seq, q_end + 1, {T}) AS q_tail, substr(f.seq, r_end + 1, {T}) AS r_tail
        FROM dna_candidates JOIN dna_strands s USING (q, strand) JOIN dna_refs f USING (ref_id)"""

_SQL: dict[str, str] = {
    # sources and sinks
    "read_fasta": "SELECT header, seq, length(seq) AS seq_len FROM dna_refs",
    "read_fastq": "SELECT replace(header, '>', '@') AS header, seq, length(seq) AS seq_len FROM dna_reads",
    "read_sequence_table": "SELECT seq_id, header, seq, length(seq) AS seq_len FROM document_texts",
    "read_accession_taxid": "SELECT accession, tax_id FROM accessions",
    "read_header_map": "SELECT old, new FROM header_names",
    "write_index": PROFILE.format("dna_postings"),
    "read_index": f"SELECT {RESULT} FROM dna_results",
    "union_indexes": """SELECT ref_id % 2 AS db_id,
        ref_id + CASE WHEN ref_id % 2 = 1 THEN (SELECT max(ref_id) + 1 FROM dna_refs WHERE ref_id % 2 = 0) ELSE 0 END AS ref_id,
        count(*) AS n, CAST(sum(rpos) AS BIGINT) AS rpos_sum, min(kmer) AS min_kmer, max(kmer) AS max_kmer
        FROM dna_postings GROUP BY ref_id""",
    "skip_bad_index": PROFILE.format("dna_postings"),
    "classify_two_indexes": "SELECT q, grp, confident, header, tax_id FROM two_db_members",
    "write_results_tiered": _tier_rows(FILE_COLUMNS),
    "combine_results": f"SELECT {FILE_COLUMNS} FROM dna_results",
    # projections, filters, scalar functions
    "normalize_seq": f"SELECT conv_id, turn, {fx.upper_ascii('text')} AS seq, length(text) AS seq_len FROM conversations",
    "reverse_complement": "SELECT q AS seq_id, seq AS rc FROM dna_strands WHERE strand = '-'",
    "both_strands": "SELECT q AS seq_id, strand, seq FROM dna_strands",
    "split_reference": f"""SELECT page_id AS seq_id, url AS header, chunk_no, substr(seq, chunk_no * 1000 + 1, 1000) AS seq,
        length(substr(seq, chunk_no * 1000 + 1, 1000)) AS seq_len FROM (
        SELECT page_id, url, seq, unnest(range(0, (length(seq) + 999) // 1000)) AS chunk_no
        FROM (SELECT page_id, url, {fx.upper_ascii('html')} AS seq FROM pages))""",
    "extract_accession": "SELECT ref_id, 'AC' || CAST(ref_id AS STRING) || '.1' AS accession FROM dna_refs",
    "translate_headers": """SELECT ref_id, coalesce(replace(new, ';', '_'), header) AS header
        FROM dna_refs LEFT JOIN header_names ON header = old""",
    "ref_kmers": "SELECT db_id, ref_id, rpos, kmer FROM dna_postings",
    "ref_kmers_text": PROFILE.format("text_postings"),
    "ref_kmers_dealt": PROFILE.format("text_postings"),
    "query_seeds": "SELECT q, strand, qpos, kmer FROM dna_seeds",
    "query_seeds_text": "SELECT q, strand, qpos, kmer FROM self_seeds",
    "drop_all_n": f"""SELECT ref_id, count(*) AS n, min(rpos) AS first_rpos FROM ({_postings(
        "(SELECT db_id, ref_id, repeat('N', 40) || substr(seq, 41) AS seq FROM dna_refs)", T)}) GROUP BY ref_id""",
    "min_query_len": "SELECT conv_id, turn, length(text) AS len FROM conversations WHERE length(text) >= 200",
    "fingerprint": f"""SELECT q, strand, qpos, h32, {_fold(28)} AS h28, {_fold(24)} AS h24, {_fold(16)} AS h16
        FROM (SELECT *, {_fnv('kmer', K)} AS h32 FROM dna_seeds)""",
    "sort_sequences": "SELECT q AS seq_id, seq FROM dna_reads ORDER BY seq, q",
    "sort_references": "SELECT seq_id, length(seq) AS seq_len FROM document_texts ORDER BY length(seq), seq_id",
    # index aggregations
    "posting_lists": """SELECT kmer, ref_id // 64 AS ref_part, rpos // 4096 AS pos_part, count(*) AS n_postings,
        string_agg(CAST(rpos AS STRING) || ':' || CAST(ref_id AS STRING), ',' ORDER BY rpos, ref_id) AS entries
        FROM dna_postings GROUP BY ALL""",
    "posting_summary": """SELECT kmer, count(*) AS n_postings, count(DISTINCT ref_id) AS n_refs, min(rpos) AS min_rpos,
        max(rpos) AS max_rpos FROM text_postings GROUP BY kmer""",
    "unique_seeds": "SELECT count(DISTINCT kmer) AS n FROM text_postings",
    "query_seed_uniqueness": "SELECT round(100.0 * count(DISTINCT kmer) / count(*), 6) AS pct FROM dna_seeds",
    "suppress_frequent_seeds": f"""WITH short AS MATERIALIZED ({_postings('text_refs', 18)})
        {PROFILE.format('(' + _suppressed('short') + ')')}""",
    "suppress_frequent_seeds_dna": f"""WITH short AS MATERIALIZED ({_postings(
        '(SELECT 0 AS db_id, q AS ref_id, seq FROM dna_reads)', 14)})
        SELECT kmer, count(*) AS n FROM ({_suppressed('short')}) GROUP BY kmer""",
    "sample_index": f"""SELECT ref_id, rpos, kmer FROM (SELECT *, {_fnv('kmer', K)} AS h32 FROM dna_postings)
        WHERE ({_fold(28)}) % 100 < 25""",
    "prune_index_to_queries": "SELECT ref_id, rpos, kmer FROM dna_postings WHERE kmer IN (SELECT kmer FROM dna_seeds)",
    "ref_stats": """SELECT count(*) AS n_refs, CAST(sum(length(seq)) AS BIGINT) AS total_len, max(length(seq)) AS max_len,
        CAST(sum(length(header)) AS BIGINT) AS total_header_len, max(length(header)) AS max_header_len FROM text_refs""",
    # joins
    "seed_hits": f"SELECT {PAIR}, qpos, rpos FROM dna_hits",
    "seed_hits_text": f"SELECT {PAIR}, qpos, rpos FROM text_hits",
    "seed_hits_text_filtered": f"SELECT {PAIR}, qpos, rpos FROM text_hits",
    "lookup_taxid": """SELECT ref_id, header, coalesce(a.tax_id, -1) AS tax_id FROM dna_refs
        LEFT JOIN accessions a ON regexp_extract(header, '^>?(\\S+)', 1) = accession""",
    "lookup_taxid_repeated": """SELECT ref_id, header, coalesce(a.tax_id, -1) AS tax_id FROM dna_refs
        LEFT JOIN (SELECT accession, max(t) AS tax_id FROM (
          SELECT accession, tax_id AS t FROM accessions UNION ALL SELECT accession, tax_id - 7 FROM accessions) GROUP BY accession) a
        ON regexp_extract(header, '^>?(\\S+)', 1) = accession""",
    "fetch_flanks": FLANKS,
    "fetch_flanks_stored": FLANKS,
    "attach_query": """SELECT q, strand, ref_id, q_start, r_start, seq AS query, length(seq) AS query_len
        FROM dna_candidates JOIN dna_strands USING (q, strand)""",
    # windows and ranking
    "consecutive_seed_filter": f"SELECT {PAIR}, qpos, rpos FROM ({_near_best('two_db_hits')})",
    "consecutive_seed_filter_dense": _pair_profile("self_near", "qpos", "rpos"),
    "chain_runs": f"SELECT {RUN} FROM dna_runs",
    "chain_runs_dense": _pair_profile("self_runs", "q_start", "r_end"),
    "chain_runs_diagonal": f"SELECT {RUN} FROM ({_runs('self_hits', T // 2, diagonal=True)})",
    "longest_run_filter": f"SELECT {RUN} FROM ({_tied_longest('dna_runs')})",
    "candidate_runs_dense": _pair_profile("self_candidates", "q_start", "r_end"),
    "best_strand": f"SELECT q, strand, ref_id, round(score, 6) AS score FROM ({_better_strand('dna_scores')})",
    "score_groups": "SELECT q, ref_id, confident, grp FROM dna_groups",
    "top_group_only": "SELECT q, ref_id, confident, grp FROM dna_groups WHERE grp = 1",
    # extension and scoring
    "extend_tail": "SELECT q, strand, ref_id, q_end, r_end, n_tail FROM dna_segments",
    "extend_head": "SELECT q, strand, ref_id, q_start, r_start, n_head FROM dna_segments",
    "segment_filter": f"SELECT q, strand, ref_id, q_start, r_start, n_head, n_mid, n_tail, m FROM dna_segments WHERE m >= {T}",
    "coverage": "SELECT q, strand, ref_id, covered, round(pct, 6) AS pct FROM dna_scores",
    "raw_score": "SELECT q, strand, ref_id, sum_sq, considered, round(raw, 6) AS raw FROM dna_scores",
    "relative_score": "SELECT q, strand, ref_id, round(score, 6) AS score FROM dna_scores",
    "drop_zero": "SELECT q, strand, ref_id, round(score, 6) AS score FROM dna_scores WHERE score > 0",
    "classify": f"SELECT {RESULT} FROM dna_results",
    "classify_all_groups": f"SELECT {RESULT} FROM all_results",
    "classify_text": f"SELECT {RESULT} FROM text_results",
    "classify_text_stored": f"SELECT {RESULT} FROM text_results",
    "classify_split": "SELECT q, grp, confident, header, tax_id FROM cut_members",
    "classify_short": f"SELECT {RESULT} FROM short_results",
    "classify_kin": f"SELECT {RESULT} FROM kin_results",
    "classify_collapsed": f"SELECT {RESULT} FROM copied_results",
    "classify_sampled": " UNION ALL ".join(
        f"SELECT '{name}' AS tier, q, confident, tax_ids, headers FROM thin_results WHERE confident >= {low}"
        for name, low in (("raw", -1.0), ("high_sensitivity", 0.4), ("balanced", 0.7))
    ),
    "segment_filter_sampled": f"SELECT q, strand, ref_id, q_start, r_start, m FROM thin_unextended WHERE m >= {T}",
    "classify_stream": f"SELECT {RESULT} FROM dna_results",
    "unique_seeds_stored": "SELECT count(DISTINCT kmer) AS n, true AS close FROM dna_postings",
    "classify_fast": f"SELECT {RESULT} FROM quick_results",
    # taxon vote and report
    "tax_occurrences": "SELECT q, grp, confident, tax_id, n FROM dna_occurrences",
    "winning_taxa": "SELECT q, grp, confident, tax_id, n, ord FROM dna_winners",
    "tax_lists": "SELECT q, grp, confident, tax_ids, occurrences FROM dna_results",
    "header_list": "SELECT q, grp, confident, headers FROM dna_results",
    "result_rows": f"SELECT {FILE_COLUMNS} FROM dna_results",
    "screen_rows": """SELECT q, r.header AS query_header, confident, refs, grp FROM (
        SELECT q, grp, confident, string_agg(CAST(ref_id AS STRING) || ';' || header || ';', ';' ORDER BY ref_id) AS refs
        FROM dna_members GROUP BY q, grp, confident) JOIN dna_reads r USING (q)""",
    "score_groups_kin": "SELECT q, ref_id, confident, grp FROM kin_groups",
    "top_group_only_kin": "SELECT q, ref_id, confident, grp FROM kin_groups WHERE grp = 1",
    "winning_taxa_kin": "SELECT q, grp, confident, tax_id, n, ord FROM kin_winners",
    "result_parts": """SELECT q, query_header, confident, tax_ids, occurrences, p.headers, grp, part_no FROM kin_results
        JOIN (SELECT q, grp, part_no, string_agg(header, ',' ORDER BY ord, ref_id) AS headers FROM kin_parts GROUP BY ALL) p
        USING (q, grp)""",
    "screen_parts": """SELECT q, r.header AS query_header, confident, refs, grp, part_no FROM (
        SELECT q, grp, confident, part_no,
               string_agg(CAST(ref_id AS STRING) || ';' || header || ';', ';' ORDER BY ref_id) AS refs
        FROM kin_lines GROUP BY q, grp, confident, part_no) JOIN dna_reads r USING (q)""",
    "tiers": _tier_rows("q, confident"),
    "relative_abundance": """SELECT header, round(100.0 * count(*) / (SELECT count(*) FROM dna_results), 6) AS pct
        FROM (SELECT split_part(headers, ',', 1) || ', primary' AS header FROM dna_results) GROUP BY header""",
    # duplicates and completeness
    "duplicate_queries": """SELECT first_id, seq_id, n_surplus FROM (
        SELECT seq_id, min(seq_id) OVER (PARTITION BY seq) AS first_id, count(*) OVER (PARTITION BY seq) - 1 AS n_surplus
        FROM document_texts) WHERE seq_id <> first_id""",
    "skip_duplicates": """SELECT min(seq_id) AS seq_id, length(seq) AS seq_len FROM document_texts GROUP BY seq""",
    "unclassified_reads": "SELECT q AS seq_id, header FROM dna_reads WHERE q NOT IN (SELECT q FROM dna_results)",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _SQL.items():
        full = with_stages(sql)
        # A query with a WITH of its own joins the stage list.
        if full.startswith("WITH ") and sql.lstrip().startswith("WITH "):
            head = full[: -len(sql)].rstrip()
            full = f"{head},\n{sql.lstrip()[len('WITH '):]}"
        out[name] = full
    return out
