"""What SQL can state of the results, in DuckDB's dialect, each from the tables alone."""

from __future__ import annotations

NEGATIVES = """WITH finite AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM finite a JOIN finite b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id, score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3"""

#: crc32 of the decimal digits of a number: the table of the polynomial, then one step for each digit.
CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"""
CRC = (
    "xor(list_reduce(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), "
    "lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def merkle(heights: int = 10) -> str:
    """The manifest, for trees of at most ``heights`` levels."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    small = f"translate(text, '{LETTERS}', '{LETTERS.lower()}')"
    fields = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    ctes = [
        CRC_TABLE,
        f"""fields AS (
  SELECT doc_id, lang, sha256({' || '.join([*fields, field('text')])}) AS leaf, sha256({' || '.join([*fields, field(small)])}) AS changed,
         coalesce({CRC.format(number='doc_id')} % 3 = 0, false) AS tampered FROM documents, crc)""",
        """d0 AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS version,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM fields)""",
        "d0nodes AS MATERIALIZED (SELECT tree, place, leaf AS name FROM d0)",
    ]

    def levels(tag: str) -> None:
        for h in range(heights):
            here, last = f"{tag}{h}nodes", h == heights - 1
            ctes.append(
                f"""{tag}{h}sides AS MATERIALIZED (
  SELECT a.tree, a.place, coalesce(string_agg(b.name, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
         coalesce(string_agg(b.name, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM {here} a JOIN {here} b ON b.tree = a.tree AND b.place // 8 = a.place // 8
  WHERE a.tree IN (SELECT tree FROM {here} WHERE place > 0) GROUP BY a.tree, a.place)"""
            )
            if not last:
                # A tree of one node goes on as it is.
                ctes.append(
                    f"""{tag}{h + 1}nodes AS MATERIALIZED (
  SELECT tree, place // 8 AS place, CASE WHEN max(total) = 1 THEN min(name) ELSE sha256(string_agg(name, '' ORDER BY place)) END AS name
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM {here}) GROUP BY tree, place // 8)"""
                )

    levels("d")
    ctes.append(f"subroots AS MATERIALIZED (SELECT tree AS lang, name, row_number() OVER (ORDER BY tree) - 1 AS place FROM d{heights - 1}nodes)")
    ctes.append("t0nodes AS MATERIALIZED (SELECT 'top' AS tree, place, name FROM subroots)")
    levels("t")
    walked = "SELECT d.doc_id, d.leaf, s.name AS subroot, s.place AS top, d.tree, d.place, d.version AS folded, '' AS proof FROM d0 d JOIN subroots s ON s.lang = d.tree"
    ctes.append(f"w0 AS MATERIALIZED ({walked})")
    number = 0
    for tag, tree, place in (("d", "w.tree", "w.place"), ("t", "'top'", "w.top")):
        for h in range(heights):
            ctes.append(
                f"""w{number + 1} AS MATERIALIZED (
  SELECT w.* REPLACE (CASE WHEN s.place IS NULL THEN w.folded ELSE sha256(s.before || w.folded || s.after) END AS folded,
                      w.proof || coalesce(s.before || s.after, '') AS proof)
  FROM w{number} w LEFT JOIN {tag}{h}sides s ON s.tree = {tree} AND s.place = {place} // {8**h})"""
            )
            number += 1
    body = ",\n".join(ctes)
    return f"""WITH {body}
SELECT doc_id, leaf, subroot, r.name AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.name AS verified
FROM w{number}, t{heights - 1}nodes r"""


def near_duplicates(k: int = 4, percent: int = 80) -> str:
    """Components of documents by the similarity of their whole sets of ``k``-word shingles."""
    small = f"translate(text, '{LETTERS}', '{LETTERS.lower()}')"
    return rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({small}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))) END AS s
  FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS MATERIALIZED (SELECT node, len(s) AS n, unnest(s) AS shingle FROM classes),
links AS MATERIALIZED (
  SELECT a.node AS x, b.node AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached(node, other) AS (
  SELECT node, node FROM classes UNION SELECT r.node, l.y FROM reached r JOIN links l ON l.x = r.other),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(r.root, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN roots r ON r.node = c.node"""


def chat(turn: str, end: str) -> str:
    """Digests and lengths of all conversations when turns stand between the control strings ``turn`` and ``end``."""

    def escaped(value: str) -> str:
        return rf"regexp_replace({value}, '<(\\*)\|', '<\\\1|', 'g')"

    role = escaped(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(turn) + len(end) + 2} + length({role}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
