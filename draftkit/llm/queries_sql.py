"""DuckDB SQL of queries that repeat a step: each round or level is a common
table expression of its own."""

from __future__ import annotations


def vector_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    ctes = [f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS double)) AS bigint)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""parts AS MATERIALIZED (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, (SELECT unnest(range({parts})) AS p))""",
            "counted AS MATERIALIZED (SELECT p, v, count(*) AS n FROM parts GROUP BY p, v)",
            f"""book0 AS MATERIALIZED (SELECT p, k, v FROM (
  SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {entries})"""]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
  SELECT c.p, c.v, any_value(c.n) AS n,
    min(cast(list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS bigint) * {entries} + b.k) AS best
  FROM counted c JOIN book{r} b ON c.p = b.p GROUP BY c.p, c.v)""")
        if r < rounds:
            ctes.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT p, k, list(cast(floor(s / n) AS bigint) ORDER BY j) AS v FROM (
      SELECT p, best % {entries} AS k, j, sum(v[j] * n) AS s, sum(n) AS n FROM near{r}, (SELECT unnest(range(1, {width + 1})) AS j) GROUP BY 1, 2, 3)
    GROUP BY p, k) m ON b.p = m.p AND b.k = m.k)""")
    return f"""
WITH {", ".join(ctes)},
coded AS (SELECT a.vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY a.p) AS code, cast(sum(best // {entries}) AS bigint) AS error
  FROM parts a JOIN near{rounds} USING (p, v) GROUP BY a.vec_id),
digest AS (SELECT sha256(string_agg(cast(x AS varchar), ',' ORDER BY p, k, j)) AS codebooks_sha256
  FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM book{rounds}))
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


def merkle_sql(arity: int = 16, levels: int = 6, upper: int = 4) -> str:
    """Trees of at most ``levels`` levels in a source and ``upper`` over the
    sources."""
    def framed(c: str, text: str | None = None) -> str:
        t = text or f"cast({c} AS varchar)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE cast(strlen({t}) AS varchar) || ':' || {t} END"

    def hashed(text: str | None = None) -> str:
        return f"sha256({' || '.join([framed(c) for c in ('doc_id', 'source', 'lang', 'n_chars')] + [framed('text', text)])})"

    def tree(name: str, depth: int) -> list[str]:
        out = []
        for k in range(depth):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT g, i // {arity} AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY g, i // {arity})")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i, (n + {arity - 1}) // {arity} AS n, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})")
        tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
        return [*out, f"{name}top AS MATERIALIZED ({tops})"]

    def climb(src: str, name: str, depth: int, at: str) -> list[str]:
        """Siblings passed (proof) and the folded digest (f), level by level."""
        out = []
        for k in range(depth):
            step = f"(x.{at} // {arity ** k}) % {arity}"
            out.append(f"""{src}{name}{k} AS MATERIALIZED (
  SELECT x.* EXCLUDE (proof, f),
    proof || CASE WHEN r.hs IS NULL THEN '' ELSE array_to_string(r.hs[1 : {step}], '') || array_to_string(r.hs[{step} + 2 :], '') END AS proof,
    CASE WHEN r.hs IS NULL THEN f ELSE sha256(array_to_string(r.hs[1 : {step}], '') || f || array_to_string(r.hs[{step} + 2 :], '')) END AS f
  FROM {src if k == 0 else f'{src}{name}{k - 1}'} x LEFT JOIN {name}r{k} r ON r.g = x.{'g' if at == 'i' else 'z'} AND r.i = x.{at} // {arity ** (k + 1)})""")
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce(list_prepend(xor(a, b), cast(range(8) AS bigint[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"""xor(4294967295, list_reduce(list_prepend(cast(4294967295 AS bigint),
      list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: cast(ascii(c) AS bigint))), lambda a, b: {bits}))"""
    return f"""
WITH hashed AS MATERIALIZED (SELECT doc_id, source, {hashed()} AS h, CASE WHEN {crc} % 5 = 0 THEN {hashed(lower)} END AS tampered FROM documents),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n, cast(0 AS bigint) AS z FROM hashed),
low0 AS MATERIALIZED (SELECT g, i, n, h FROM placed),
{", ".join(tree("low", levels))},
up0 AS MATERIALIZED (SELECT cast(0 AS bigint) AS g, g AS i, count(*) OVER () AS n, h FROM lowtop),
{", ".join(tree("up", upper))},
path AS MATERIALIZED (SELECT doc_id, h, g, i, z, '' AS proof, coalesce(tampered, h) AS f FROM placed),
{", ".join(climb("path", "low", levels, "i"))},
{", ".join(climb(f"pathlow{levels - 1}", "up", upper, "g"))}
SELECT p.doc_id, p.h AS leaf, lowtop.h AS subroot, uptop.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = uptop.h AS verified
FROM pathlow{levels - 1}up{upper - 1} p JOIN lowtop ON lowtop.g = p.g, uptop"""


VECTOR_SQL = vector_sql()
MERKLE_SQL = merkle_sql()
