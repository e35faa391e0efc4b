"""What contracts define in SQL of results that SQL cannot have whole: rows of their own beside the full queries, from the same operators."""

from __future__ import annotations

from oneway.llm.conversation_repair import crc32_sql

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def word_counts() -> str:
    return f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_words FROM documents"


def url_rules(rules: tuple[tuple[str, str, str], ...]) -> str:
    """Host, path and the longest rule that fits."""
    fits = lambda host, path: f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
    cases = " ".join(f"WHEN {fits(host, path)} THEN '{host}{path}'" for _, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])))
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""SELECT page_id, host, path, CASE {cases} END AS rule FROM (SELECT page_id, {LOWER.format("h")} AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path
      FROM (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM (SELECT page_id, {rest} AS r FROM pages)))"""


def base_scores(folds: int = 7, held: int = 2) -> str:
    """Tokens, known tokens and the add-one score of every document; a space, which no word has, stands for the end."""
    out = f"coalesce({crc32_sql('doc_id::VARCHAR')} % {folds} = {held}, false)"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_append(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}'), ' ') AS ts, {out} AS held_out FROM documents),
    t AS (SELECT rid, held_out, unnest(ts) AS tok FROM d), c AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY tok), s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
    b AS (SELECT rid, count(c.c) AS known, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))) AS score FROM t LEFT JOIN c USING (tok), s GROUP BY rid)
    SELECT doc_id, held_out, len(ts)::BIGINT AS n_tokens, known AS n_known, n AS train_tokens, round(score, 3) AS base_score FROM d JOIN b USING (rid), s"""


def mix_targets(weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> str:
    """Sizes, and targets by rounds in which sources over their cap are capped and the excess is shared again."""
    return f"""WITH RECURSIVE z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
    g AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM z GROUP BY source),
    l AS (SELECT list(s ORDER BY i) AS s, list([{', '.join(map(str, weights))}][(i - 1) % {len(weights)} + 1] ORDER BY i) AS w, {share} * sum(s) AS total FROM g),
    r AS (SELECT 0 AS k, list_transform(s, lambda x: false) AS c FROM l
      UNION ALL SELECT k + 1, n FROM (SELECT k, c, list_transform(range(1, len(c) + 1), lambda i: c[i] OR open * w[i] / heft > {most} * s[i]) AS n
        FROM (SELECT k, c, s, w, total - list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN {most} * s[i] ELSE 0 END)) AS open, list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN 0 ELSE w[i] END)) AS heft FROM r, l)) WHERE n <> c),
    e AS (SELECT arg_max(c, k) AS c FROM r), o AS (SELECT c, s, w, total - list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN {most} * s[i] ELSE 0 END)) AS open, list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] THEN 0 ELSE w[i] END)) AS heft FROM e, l)
    SELECT doc_id, size, g.s AS source_size, round(CASE WHEN o.c[g.i] THEN {most} * g.s ELSE open * o.w[g.i] / heft END, 3) AS target FROM z JOIN g ON g.source IS NOT DISTINCT FROM z.source, o"""


def secret_counts() -> str:
    """How many spans each pattern finds."""
    kinds = {"assign": (r'''(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 1, 8), "access": ("AKIA[A-Z0-9]+", 0, 16), "hex": ("[0-9a-f]+", 0, 32)}
    count = lambda p, group, least: f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{p}', {group}), lambda x: length(x) >= {least}))::BIGINT"
    return f"SELECT doc_id, {', '.join(f'{count(*v)} AS n_{k}' for k, v in kinds.items())} FROM documents"
