"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

from .mixing import BLOCK_TOKENS, CELLS, DECIMALS, MAX_EPOCHS, NO_SOURCE, SEED
from .repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, MIN_WORDS, WINDOW
from .sharding import CELL_BITS, HASH_BITS

SHARDS = 8
BLANKS = r"\x20\x09-\x0D"


def repeated_words(windows: dict[str, int]) -> str:
    """Tables (doc_id, n) of the words that lie in windows found twice or more in a text, by name and width."""
    out = []
    for name, width in windows.items():
        out.append(
            f"""{name}_w AS (SELECT r, i, array_to_string(w[i:i + {width - 1}], ' ') AS x FROM words, unnest(range(1, len(w) - {width - 2})) t(i) WHERE len(w) >= {width}),
    {name}_r AS (SELECT r, unnest(list(i)) AS i FROM {name}_w GROUP BY r, x HAVING count(*) > 1),
    {name} AS (SELECT r, count(DISTINCT i + k) AS n FROM {name}_r, range({width}) t(k) GROUP BY r)"""
        )
    return ",\n    ".join(out)


OP1 = f"""
    WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, regexp_extract_all(text, '[^{BLANKS}]+') AS w FROM rows),
    lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '[^{BLANKS}]') GROUP BY r),
    {repeated_words({"short": WINDOW, "covered": MIN_REPEAT})},
    search(r, n, w, lo, hi) AS (
        SELECT r, len(w)::BIGINT, w, 0::BIGINT, NULL::BIGINT FROM words
        UNION ALL SELECT r, n, w, CASE WHEN found THEN k ELSE lo END, CASE WHEN found THEN hi ELSE k END FROM (
            SELECT *, k < n AND len(list_distinct(x)) < len(x) AS found FROM (
                SELECT *, list_transform(range(1, n - k + 2), lambda i: hash(w[i:i + k - 1])) AS x FROM (
                    SELECT *, CASE WHEN hi IS NULL THEN greatest(1, 2 * lo) ELSE (lo + hi) // 2 END AS k FROM search WHERE hi IS NULL OR hi - lo > 1)))
    ),
    longest AS (SELECT r, max(lo) AS n FROM search GROUP BY r),
    counted AS (
        SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[{BLANKS}]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(s.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS covered_words, g.n AS longest_repeat
        FROM rows JOIN words USING (r) LEFT JOIN lines l USING (r) LEFT JOIN short s USING (r) LEFT JOIN covered c USING (r) LEFT JOIN longest g USING (r)
    ),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
    SELECT *, NOT base_failed AND covered_words <= {MAX_COVERED} * n_words AND longest_repeat <= {MAX_LONGEST} AS kept FROM judged
"""


def _number(text: str, digits: int = HASH_BITS // 4) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


OP4 = f"""
    WITH units AS (
        SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS s, substr(md5(coalesce(text, '')), 1, 16) AS t, count(*) AS m, max(len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+')))::BIGINT AS n
        FROM documents GROUP BY ALL
    ),
    tokens AS (SELECT s, sum(n * m)::BIGINT AS total FROM units GROUP BY s),
    solved AS (
        SELECT sum(total)::DOUBLE AS whole, max(total) / sum(total) AS top,
            CASE WHEN max(total) <= {MAX_EPOCHS} * min(total) FILTER (total > 0) THEN 0.0 ELSE 1 - ln({MAX_EPOCHS}) / ln(max(total)::DOUBLE / min(total) FILTER (total > 0)) END AS x
        FROM tokens
    ),
    scaled AS (SELECT any_value(whole) AS whole, any_value(x) AS x, sum(CASE WHEN total > 0 THEN (total / whole) ** x END) AS z, any_value(top) AS top FROM tokens, solved),
    planned AS (
        SELECT s, total, whole * z * top ** (1 - x) AS budget, CASE WHEN total > 0 THEN (total / whole) ** x / z ELSE 0.0 END AS weight, CASE WHEN total > 0 THEN whole * z * top ** (1 - x) * ((total / whole) ** x / z) / total ELSE 1.0 END AS e
        FROM tokens, scaled
    ),
    plan AS (SELECT s, total, round(weight, {DECIMALS}) AS weight, CASE WHEN abs(e - round(e)) < 1e-9 THEN round(e) ELSE e END AS epochs, greatest(1, round(budget / {BLOCK_TOKENS}))::BIGINT AS blocks FROM planned),
    copies AS (SELECT *, {_number(f"'{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || t")} AS o FROM units JOIN plan USING (s), range(ceil(epochs)::BIGINT) r(epoch)),
    placed AS (
        SELECT *, epoch * total + coalesce(sum(n * m) OVER (PARTITION BY s, epoch ORDER BY o // {2**HASH_BITS // CELLS}, o, doc_id NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spot FROM copies
    ),
    kept AS (
        SELECT *, least(blocks - 1, CASE WHEN total > 0 THEN floor(spot / (epochs * total) * blocks)::BIGINT ELSE o % blocks END) AS block
        FROM placed WHERE spot < epochs * total OR total = 0 OR epoch + 1 <= epochs
    )
    SELECT doc_id, nullif(s, '{NO_SOURCE}') AS source, n AS n_tokens, weight, epoch::INT AS epoch, block,
        row_number() OVER (PARTITION BY block ORDER BY {_number(f"'{SEED + 1}|' || o")}, s, epoch, doc_id NULLS FIRST, t, k) - 1 AS slot
    FROM kept, range(1, m + 1) r(k)
""".replace(f"'{NO_SOURCE}'", "chr(0) || 'null'")


def _minimax(shards: int) -> str:
    """The smallest capacity by dynamic programming over the ends of groups, and the greedy cuts for it."""
    steps = ["d1 AS (SELECT c, c AS worst FROM ends)"]
    for k in range(2, shards + 1):
        steps.append(f"d{k} AS (SELECT b.c, min(greatest(a.worst, b.c - a.c)) AS worst FROM (SELECT * FROM d{k - 1} UNION ALL SELECT 0, 0) a JOIN ends b ON a.c <= b.c GROUP BY b.c)")
    steps.append(f"best AS (SELECT worst AS capacity FROM d{shards} ORDER BY c DESC LIMIT 1)")
    steps.append("cut1 AS (SELECT max(c) AS c FROM ends, best WHERE c <= capacity)")
    for k in range(2, shards):
        steps.append(f"cut{k} AS (SELECT max(e.c) AS c FROM ends e, best, cut{k - 1} p WHERE e.c <= p.c + capacity)")
    return ",\n    ".join(steps)


#: crc: the table of CRC-32, from its polynomial.
CRC = f"""crc0 AS (SELECT x, x AS v FROM range(256) r(x)),
    {", ".join(f"crc{k + 1} AS (SELECT x, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM crc{k})" for k in range(8))},
    crc AS (SELECT list(v ORDER BY x) AS tab FROM crc8)"""


def _crc32(raw: str) -> str:
    """crc32 of a text's bytes, given as hex digits; needs crc."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length({raw}), 2), lambda i: ('0x' || substr({raw}, i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


OP8 = f"""
    WITH {CRC},
    texts AS (SELECT text, hex(encode(text)) AS raw FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
    sums AS (
        SELECT text, {_crc32("raw")} AS text_crc32,
            {_number("text")} AS h, octet_length(encode(text)) + 1 AS size
        FROM texts, crc
    ),
    rows AS (SELECT doc_id, size, text_crc32, h, {_number("coalesce(doc_id::VARCHAR, '') || '|' || h", CELL_BITS // 4)} AS cell FROM documents d JOIN sums s ON coalesce(d.text, '') = s.text),
    ends AS (SELECT h, sum(sum(size)) OVER (ORDER BY h)::BIGINT AS c FROM rows GROUP BY h),
    {_minimax(SHARDS)},
    dealt AS (SELECT r.*, {" + ".join(f"(e.c > (SELECT c FROM cut{k}))::INT" for k in range(1, SHARDS))} AS shard FROM rows r JOIN ends e USING (h))
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM dealt
"""

#: Levels of a source's tree and of the tree over the sources: 16^6 documents a source, 16^4 sources.
TREE, CROWN = 6, 4


def _leaf(text: str = "text") -> str:
    framed = " || ".join(f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({framed})"


def _tree(name: str, levels: int) -> str:
    """name1, name2, ...: the levels over name0 (g, pos, n, node); name_r1, ...: the runs that they come from."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"{name}_r{k} AS (SELECT g, pos // 16 AS pos, string_agg(node, '' ORDER BY pos) AS run, max(n) AS n FROM {name}{k - 1} GROUP BY g, pos // 16)")
        out.append(f"{name}{k} AS (SELECT g, pos, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS node FROM {name}_r{k})")
    return ",\n    ".join(out)


def _folds(name: str, tree: str, g: str, pos: str, levels: int) -> str:
    """name1, name2, ... after name0: fold and proof taken up a level each."""
    out = []
    for k in range(1, levels + 1):
        at = f"64 * (p.{pos} // {16 ** (k - 1)} % 16)"
        left, right = f"substr(r.run, 1, {at})", f"substr(r.run, {at} + 65)"
        out.append(
            f"{name}{k} AS (SELECT p.* EXCLUDE (fold, proof), CASE WHEN r.n > 1 THEN sha256({left} || p.fold || {right}) ELSE p.fold END AS fold, CASE WHEN r.n > 1 THEN p.proof || {left} || {right} ELSE p.proof END AS proof "
            f"FROM {name}{k - 1} p JOIN {tree}_r{k} r ON r.g = {g} AND r.pos = p.{pos} // {16**k})"
        )
    return ",\n    ".join(out)


OP13 = f"""
    WITH {CRC},
    rows AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, hex(encode(doc_id::VARCHAR)) AS raw FROM documents),
    leaves AS (
        SELECT g, doc_id, {_leaf()} AS node, CASE WHEN doc_id IS NOT NULL AND {_crc32("raw")} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM rows, crc
    ),
    t0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
    {_tree("t", TREE)},
    c0 AS (SELECT '' AS g, g AS source, node, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM t{TREE}),
    {_tree("c", CROWN)},
    p0 AS (SELECT t.*, c.pos AS place, c.node AS subroot, coalesce(t.tampered, t.node) AS fold, '' AS proof FROM t0 t JOIN c0 c ON c.source = t.g),
    {_folds("p", "t", "p.g", "pos", TREE)},
    q0 AS (SELECT * FROM p{TREE}),
    {_folds("q", "c", "''", "place", CROWN)}
    SELECT doc_id, q.node AS leaf, subroot, c.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = c.node AS verified FROM q{CROWN} q, c{CROWN} c
"""

ORACLES = {"op13_merkle_manifest": OP13, "op1_suffix_repetition": OP1, "op4_temperature_mixture": OP4, "op8_minimax_shards": OP8}
