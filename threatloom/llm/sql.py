"""SQL that registered text queries must agree with, where SQL can express them."""


def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters: its reflected polynomial, eight steps a character (-1 marks a step)."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_transform({codes}, lambda v: v::BIGINT), lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Recursive table of all nodes (tree, level, place, digest, of), `of` being how many the level has."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2)"""


def _climb(name: str, start: str, tree: str) -> str:
    """From rows (doc_id, tree, place, node, told) of `start` up to the tops: `told` gathers siblings, `node` is folded with them."""
    return f"""{name} AS (
  SELECT doc_id, tree, 0 AS level, place, node, told FROM {start}
  UNION ALL
  SELECT w.doc_id, w.tree, w.level + 1, w.place // 2,
    CASE WHEN w.place % 2 = 1 THEN sha256(coalesce(s.digest, '') || w.node) ELSE sha256(w.node || coalesce(s.digest, '')) END,
    w.told || coalesce(s.digest, '')
  FROM {name} w JOIN {tree} t ON t.tree = w.tree AND t.level = w.level AND t.place = w.place AND t.n > 1
    LEFT JOIN {tree} s ON s.tree = w.tree AND s.level = w.level AND s.place = xor(w.place, 1))"""


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS digest,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS tampered
  FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place FROM docs),
{_tree("nodes", "placed")},
kept AS MATERIALIZED (SELECT * FROM nodes),
tops AS MATERIALIZED (
  SELECT '' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM kept WHERE n = 1),
{_tree("over", "tops")},
over_kept AS MATERIALIZED (SELECT * FROM over),
start AS (SELECT doc_id, tree, place, tampered AS node, '' AS told FROM placed),
{_climb("climb", "start", "kept")},
reached AS MATERIALIZED (
  SELECT c.doc_id, '' AS tree, t.place, c.node, c.told, t.digest AS subroot
  FROM climb c JOIN kept k ON k.tree = c.tree AND k.level = c.level AND k.n = 1 JOIN tops t ON t.lang = c.tree),
{_climb("higher", "reached", "over_kept")},
ended AS (SELECT h.* FROM higher h JOIN over_kept o ON o.level = h.level AND o.place = h.place AND o.n = 1)
SELECT p.doc_id, p.digest AS leaf, r.subroot, o.digest AS root, sha256(e.told) AS proof_sha256, e.node AS folded_root,
  e.node = o.digest AS verified
FROM placed p JOIN reached r USING (doc_id) JOIN ended e USING (doc_id) CROSS JOIN (SELECT digest FROM over_kept WHERE n = 1) o
"""

_SPACES = r"\x20\x09-\x0D"

REPEATS = f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS words FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row FROM split),
windows AS (
  SELECT row, doc_id, spot, array_to_string(list_slice(words, spot, spot + 49), ' ') AS body
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS spot FROM numbered WHERE len(words) >= 50)),
judged AS (SELECT row, spot, min(doc_id) OVER (PARTITION BY body) < doc_id AS repeated FROM windows),
gone AS (
  SELECT row, list(DISTINCT place) AS places
  FROM (SELECT row, unnest(range(spot, spot + 50)) AS place FROM judged WHERE repeated) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, i: places IS NULL OR NOT list_contains(places, i)), ' ')) AS kept_sha256
FROM numbered LEFT JOIN gone USING (row)
"""

ORACLE = {"op11_repeats": REPEATS, "op13_merkle": MERKLE}
