"""The registered queries of the training-data operators."""

from __future__ import annotations

from .ann import op5_ann
from .bpe import op7_bpe
from .chat import op1_chat
from .exact import op12_exact
from .langid import op9_langid
from .media import op2_media
from .mixing import op4_mixing
from .pii import op8_pii
from .ranked import op11_ranked
from .repair import op13_repair
from .simhash import op6_simhash
from .substring import op10_substring
from .toxicity import op3_toxicity

QUERIES = {
    "op1_chat": op1_chat,
    "op2_media": op2_media,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_ann": op5_ann,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_pii": op8_pii,
    "op9_langid": op9_langid,
    "op10_substring": op10_substring,
    "op11_ranked": op11_ranked,
    "op12_exact": op12_exact,
    "op13_repair": op13_repair,
}
TURNS = "c AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')"

#: Length of a text once escaped: one character more for each control string and each escape character.
ESCAPED = r"length(regexp_replace(text, '\\|\[/?(SYS|INST|ANS|TEXT)\]|\[ROLE\]|</?s>', '\0 ', 'g'))"

#: Texts, digests and validity of conversations in the roles of the template (others are covered by tests).
CHAT_SQL = f"""WITH {TURNS} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
(7 + sum({ESCAPED} + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 11 ELSE 19 + length(role) END))::BIGINT AS formatted_chars,
regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid FROM c GROUP BY conv_id"""

#: Every window's words in one string; a word goes if a window that covers it starts in a smaller document, too.
SUBSTRING_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p), least_ AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
gone AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM h JOIN least_ USING (h) WHERE doc_id > lo GROUP BY doc_id),
off AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS j FROM (SELECT doc_id, unnest(starts) AS s FROM gone)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM words LEFT JOIN off USING (doc_id, j) WHERE off.j IS NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS_OF = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document's score for every item from the terms both have.
RANKED_SQL = f"""WITH t AS (SELECT doc_id, unnest({TERMS_OF}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM size, whole), q AS (SELECT DISTINCT item_id, unnest({TERMS_OF}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), whole),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM w JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""

#: Groups of texts by digest.
EXACT_SQL = f"""WITH d AS (SELECT doc_id, sha256({LOW}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d"""


def _repair_sql() -> str:
    """Damage, costs from the last row to the first (one column for each state of the grammar), then the least cheapest edits from the first to the last."""
    fill = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after a role that fits is written
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    kept = lambda q: "CASE " + " ".join(f"WHEN r.c = '{c}' THEN {{0}}{to}" for c, to in keep[q].items()) + " END"
    row = [f"least(3 + v{q}, CASE WHEN r.fault NOT IN ('blank', 'duplicate') THEN least(r.more + {kept(q).format('v')}, 2 + r.more + v{fill[q]}) END)" for q in range(4)]
    # with one insertion, or two (from states 0 and 1, over 2, to 3)
    closed = ["least(x0, 2 + x2, 4 + x3)", "least(x1, 2 + x2, 4 + x3)", "least(x2, 2 + x3)", "least(x3, 2 + x2)"]
    pick = lambda of: "CASE w.q " + " ".join(f"WHEN {q} THEN {of(q)}" for q in range(4)) + " END"
    here, drop, insert = pick(lambda q: f"h.v{q}"), pick(lambda q: f"n.v{q}"), pick(lambda q: f"h.v{fill[q]}")
    keeping, to_kept = pick(lambda q: kept(q).format("n.v")), pick(lambda q: kept(q).format(""))
    return f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS t(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT keyed.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 20 AS f FROM keyed, crc),
broken AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE f WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM broken),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS c FROM placed),
r AS (SELECT *, CASE fault WHEN 'truncated' THEN 1 ELSE 0 END AS more, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM judged),
v(conv_id, i, v0, v1, v2, v3) AS (SELECT conv_id, n, 0::BIGINT, 4::BIGINT, 2::BIGINT, 0::BIGINT FROM (SELECT DISTINCT conv_id, n FROM r)
UNION ALL SELECT conv_id, i, {", ".join(closed)} FROM (SELECT v.conv_id, v.i - 1 AS i, {", ".join(f"{x} AS x{q}" for q, x in enumerate(row))} FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i)),
w(conv_id, i, q, audit, said) AS (SELECT conv_id, 0::BIGINT, 0, '', []::VARCHAR[] FROM v WHERE i = 0
UNION ALL SELECT conv_id, CASE step WHEN 'I' THEN i ELSE i + 1 END, CASE step WHEN 'D' THEN q WHEN 'K' THEN kept ELSE fill END, audit || step,
CASE step WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, role_of || ':' || text) ELSE list_append(said, role_of || ':') END FROM (
SELECT w.*, r.role, r.text, {pick(lambda q: fill[q])} AS fill, {pick(lambda q: "'user'" if fill[q] == 2 else "'assistant'")} AS role_of, {to_kept} AS kept,
CASE WHEN r.i IS NOT NULL AND 3 + {drop} = {here} THEN 'D' WHEN 2 + {insert} = {here} THEN 'I' WHEN r.more + {keeping} = {here} AND r.fault NOT IN ('blank', 'duplicate') THEN 'K' ELSE 'R' END AS step
FROM w JOIN v h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 LEFT JOIN v n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1
WHERE r.i IS NOT NULL OR {here} > 0)),
best AS (SELECT conv_id, arg_max(audit, len(audit)) AS audit, arg_max(said, len(audit)) AS said FROM w GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v0, 0) AS cost, coalesce(audit, '') AS audit,
sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM e.conv_id AND v.i = 0"""


#: SQL lacks trained models, fingerprints, merges, knapsacks, graphs and positions of matches; tests hold
#: those operators against brute force, a round trip or accuracy on rows not learned from.
ORACLES: dict[str, str] = {"op1_chat": CHAT_SQL, "op10_substring": SUBSTRING_SQL, "op11_ranked": RANKED_SQL, "op12_exact": EXACT_SQL, "op13_repair": _repair_sql()}
