"""The views of :mod:`tesserae.plans.views` restated in plain SQL, for checking.

These texts are run by another engine on the same tables. They are written for clarity,
not speed, and share no code with the Spark plans.
"""

from __future__ import annotations


def u(*parts: str) -> str:
    """SQL of the seeded uniform."""
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


def r(expr: str, digits: int = 6) -> str:
    """SQL of round-half-up to ``digits``."""
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


def parent(lod: str, patch: str) -> str:
    """SQL of the parent patch index on grids of side 2**lod."""
    side = f"(1 << ({lod})::INTEGER)"
    return f"((({patch}) // {side} // 2) * ({side} // 2) + (({patch}) % {side}) // 2)"


def zorder(lod: str, patch: str) -> str:
    side = f"(1 << ({lod})::INTEGER)"
    row, col = f"(({patch}) // {side})", f"(({patch}) % {side})"
    return " + ".join(
        f"(({col} >> {b}) & 1) * {4**b} + (({row} >> {b}) & 1) * {2 * 4**b}" for b in range(5)
    )


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


view(
    "tokens",
    """SELECT l_orderkey AS sample_key, pos, code,
         CASE WHEN pos < 1 THEN 0 WHEN pos < 5 THEN 1 ELSE 2 END::BIGINT AS lod,
         pos - CASE WHEN pos < 1 THEN 0 WHEN pos < 5 THEN 1 ELSE 5 END AS patch
       FROM (SELECT l_orderkey, l_partkey % 500 AS code,
               row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos
             FROM lineitem)""",
)
view(
    "predicted",
    f"""SELECT *, CASE WHEN {u("'pred'", "sample_key", "pos")} < 0.3
                       THEN (code + 1) % 500 ELSE code END AS pred FROM tokens""",
    "tokens",
)
view(
    "masked",
    f"""SELECT t.*, row_number() OVER (PARTITION BY sample_key ORDER BY draw, pos) AS rnk,
           greatest(1, round_even(len * acos(ratio_draw) / (pi() * 0.5), 0))::BIGINT AS n_masked
        FROM (SELECT sample_key, pos, code, {u("'perm'", "sample_key", "pos")} AS draw,
                count(*) OVER (PARTITION BY sample_key) AS len,
                {u("'ratio'", "sample_key")} AS ratio_draw FROM tokens) t""",
    "tokens",
)
view(
    "vec",
    """SELECT vec_id AS image_id, label::BIGINT AS label, p, embedding[p + 1]::DOUBLE AS v
       FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS p FROM embeddings)""",
)
view(
    "pixels",
    """SELECT image_id, p // 8 AS y, p % 8 AS x, v,
         least(greatest(floor((v + 1) * 127.5), 0), 255)::BIGINT AS gray FROM vec""",
    "vec",
)
view(
    "pair",
    """SELECT image_id, p, (v + 1) / 2 AS re, (floor(v * 10 + 0.5) / 10 + 1) / 2 AS fa FROM vec""",
    "vec",
)
view(
    "seg",
    """SELECT image_id, y, x,
         CASE WHEN (image_id + y + x) % 50 = 0 THEN 1000
              ELSE least(greatest(floor((v + 0.3) * 6), 0), 3) END::BIGINT AS gt,
         least(greatest(floor((floor(v * 10 + 0.5) / 10 + 0.3) * 6), 0), 3)::BIGINT AS pred
       FROM pixels""",
    "pixels",
)
view(
    "codebook",
    f"SELECT label AS code, p, {r('avg(v)')} AS e FROM vec GROUP BY label, p",
    "vec",
)
view(
    "logits",
    """SELECT v.image_id, v.label, row_number() OVER (PARTITION BY v.image_id ORDER BY c.code) - 1 AS class,
         10.0::DOUBLE * sum(v.v * c.e) AS z
       FROM vec v JOIN codebook c USING (p) GROUP BY v.image_id, v.label, c.code""",
    "vec",
    "codebook",
)
view(
    "probs",
    """SELECT image_id, label, class, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY image_id) AS p
       FROM (SELECT *, max(z) OVER (PARTITION BY image_id) AS m FROM logits)""",
    "logits",
)
view(
    "docs",
    """SELECT doc_id // 20 AS shard, lpad(doc_id::VARCHAR, 8, '0') AS key, n_chars, doc_id
       FROM documents""",
)
view(
    "members",
    """SELECT shard, key, ext FROM docs, (VALUES ('code_indices.npy'), ('lod_indices.npy')) e(ext)
       UNION ALL SELECT shard, key, 'patch_indices.npy' FROM docs WHERE n_chars % 97 <> 0
       UNION ALL SELECT shard, key, 'cls' FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "docs",
)
view(
    "raw_labels",
    """SELECT s_suppkey AS key, CASE WHEN s_suppkey % 13 = 0 THEN 'unknown' ELSE n_name END AS label_str
       FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
view(
    "log_cols",
    """SELECT user_id AS run, event_id, ts, strftime(ts, '%m/%d %H:%M:%S') AS stamp,
         floor(value * 100 + 0.5)::BIGINT AS cents FROM events""",
)
view(
    "log_lines",
    """SELECT run, event_id, '[' || stamp || ' train]: Data (t): 0.' || lpad((event_id % 10000)::VARCHAR, 4, '0')
         || ', ' || (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0')
         || '/s/gpu Batch (t): 0.' || lpad((event_id * 7 % 10000)::VARCHAR, 4, '0')
         || ' LR: 0.000100 Step: ' || event_id::VARCHAR
         || ' Loss: 6.' || lpad((event_id * 13 % 10000)::VARCHAR, 4, '0') AS line FROM log_cols""",
    "log_cols",
)
view(
    "boxes",
    """SELECT *, row_number() OVER (ORDER BY image_id, category_id, x, y, w, h, score, price) AS det_id
       FROM (SELECT l_orderkey AS image_id, l_suppkey % 3 AS category_id, l_quantity::BIGINT * 2 AS x,
               l_linenumber::BIGINT * 10 AS y, l_partkey % 30 + 20 AS w, l_suppkey % 20 + 20 AS h,
               l_quantity::BIGINT * 2 + l_partkey % 7 AS px, (l_partkey % 100) / 100.0::DOUBLE AS score,
               l_extendedprice AS price FROM lineitem)""",
)
view(
    "full_tree",
    """SELECT l.lod, p.patch FROM (SELECT unnest(range(6))::BIGINT AS lod) l,
         LATERAL (SELECT unnest(range((1 << (2 * l.lod)::INTEGER)::BIGINT)) AS patch) p""",
)


def _level(lod: int, condition: str) -> str:
    """Children of level ``lod - 1`` whose parent meets the condition."""
    side = 2 ** (lod - 1)
    below = 2 * side
    first = f"(patch // {side}) * 2 * {below} + (patch % {side}) * 2"
    return (
        f"SELECT tree_id, {lod}::BIGINT AS lod, {first} + o AS patch FROM t{lod - 1}, "
        f"(VALUES (0), (1), ({below}), ({below + 1})) c(o) WHERE {condition}"
    )


_DRAW = u("tree_id", "lod", "patch")
for _lod in range(6):
    if _lod == 0:
        view("t0", "SELECT c_custkey AS tree_id, 0::BIGINT AS lod, 0::BIGINT AS patch FROM customer")
    else:
        _cond = "true" if _lod <= 3 else f"{_DRAW} < {0.3 if _lod == 4 else 0.2}"
        view(f"t{_lod}", _level(_lod, _cond), f"t{_lod - 1}")
view("trees", " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(6)), *[f"t{i}" for i in range(6)])
view(
    "node_status",
    f"""SELECT i.c_custkey AS tree_id, f.lod, f.patch,
          CASE WHEN n.patch IS NOT NULL THEN 1 WHEN q.patch IS NOT NULL THEN 0 ELSE -1 END::BIGINT AS status
        FROM customer i CROSS JOIN full_tree f
        LEFT JOIN trees n ON n.tree_id = i.c_custkey AND n.lod = f.lod AND n.patch = f.patch
        LEFT JOIN trees q ON q.tree_id = i.c_custkey AND q.lod = f.lod - 1
          AND q.patch = {parent("f.lod", "f.patch")}""",
    "full_tree",
    "trees",
)


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the named views and everything they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    text = body.lstrip()
    if text.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{body}"
