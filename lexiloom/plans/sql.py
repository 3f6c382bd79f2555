"""Pieces of DuckDB SQL for the catalogue: rule chains, and named subqueries that build on each other."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..functions import text

#: Values of the oracle-checked models.
K, ALPHA, BETA, DF_CUT, TF_CUT = 8, 0.001, 0.001, 0.25, 3.0


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(x: str, rules: Sequence[text.Rule]) -> str:
    for pattern, replacement in rules:
        to = quoted(replacement).replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"
    return x


def folded(x: str) -> str:
    table = text.folding()
    for c, s in table.items():
        if len(s) > 1:
            x = f"replace({x}, {quoted(c)}, {quoted(s)})"
    single = {c: s for c, s in table.items() if len(s) == 1 and s != "\n"}
    x = f"translate({x}, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    x = f"replace({x}, chr(8233), chr(10))"
    return chain(f"regexp_replace({x}, '[^\\x00-\\x7E]', ' ', 'g')", text.FOLD_TAIL)


def topic_text(x: str) -> str:
    for rules in (None, text.REMOVE_MARKUP, text.REMOVE_NUMBERS, text.REMOVE_NONSENTENTIAL_PUNCT, text.REMOVE_CAPS, text.REMOVE_ISOLATED_SYMBOLS, [(r"\s+", " ")]):
        x = folded(x) if rules is None else chain(x, rules)
    return f"(CASE WHEN {x} = ' ' THEN '' ELSE {x} END)"


P = f"CAST(doc_id % {K} AS INTEGER)"
CTES: dict[str, str] = {
    "doc": r"SELECT doc_id, lang, source, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents",
    "norm": f"SELECT doc_id, lang, {chain('text', text.NORMALIZE_TEXT)} AS text FROM documents",
    "topic": f"SELECT doc_id, {topic_text('text')} AS text FROM norm",
    "sent0": f"SELECT doc_id, unnest(string_split({chain('text', text.SENTENCE_BREAKS)}, chr(10))) AS s FROM topic",
    "sent": r"SELECT doc_id, regexp_replace(regexp_replace(s, '\s+$', ''), '^\s+', '') AS s FROM sent0",
    "tok": "SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents",
    "tc": "SELECT doc_id, term, count(*)::DOUBLE AS cnt FROM tok WHERE term <> '' GROUP BY doc_id, term",
    "nd": "SELECT count(DISTINCT doc_id)::DOUBLE AS n, sum(cnt)::DOUBLE AS total FROM tc",
    "voc": "SELECT term, sum(cnt)::DOUBLE AS tf, sum(least(cnt, 1.0::DOUBLE))::DOUBLE AS df FROM tc GROUP BY term",
    "vw": f"SELECT term, tf, df, CASE WHEN df / n >= {DF_CUT} OR tf <= {TF_CUT} THEN 0.0::DOUBLE ELSE -ln(df / n) END AS weight FROM voc, nd",
    "pc": "SELECT doc_id, term, cnt, weight FROM tc JOIN vw USING (term) WHERE weight > 0",
    "lab": f"SELECT doc_id, {P} AS z FROM documents",
    "zs": f"SELECT unnest(range({K}))::INTEGER AS z",
    "len": "SELECT doc_id, sum(cnt) AS n_words FROM pc GROUP BY doc_id",
    "mz": "SELECT z, sum(cnt) AS m FROM pc JOIN lab USING (doc_id) GROUP BY z",
    "pz0": f"SELECT z, (coalesce(m, 0) + {ALPHA}) / (SELECT sum(coalesce(m, 0) + {ALPHA}) FROM zs LEFT JOIN mz USING (z)) AS p FROM zs LEFT JOIN mz USING (z)",
    "wz_c": f"SELECT term, z, coalesce(c, 0) + {BETA} AS c FROM (SELECT DISTINCT term FROM pc) CROSS JOIN zs LEFT JOIN (SELECT term, z, sum(cnt) AS c FROM pc JOIN lab USING (doc_id) GROUP BY term, z) USING (term, z)",
    "wz0": "SELECT term, z, c / sum(c) OVER (PARTITION BY z) AS p FROM wz_c",
    "zd_c": "SELECT doc_id, w.z, sum(cnt * w.p * q.p) AS c FROM pc JOIN wz0 w USING (term) JOIN pz0 q ON q.z = w.z GROUP BY doc_id, w.z",
    "zd0": f"SELECT doc_id, z, coalesce(c / sum(c) OVER (PARTITION BY doc_id), {1 / K}) AS p FROM documents CROSS JOIN zs LEFT JOIN zd_c USING (doc_id, z)",
}


def em(i: int) -> dict[str, str]:
    """Subqueries of iteration i + 1: wz{i+1} and zd{i+1}."""
    return {
        f"e{i}": f"SELECT doc_id, term, d.z, cnt, w.p * d.p AS j, sum(w.p * d.p) OVER (PARTITION BY doc_id, term) AS mix FROM pc JOIN wz{i} w USING (term) JOIN zd{i} d USING (doc_id) WHERE w.z = d.z",
        f"wzc{i + 1}": f"SELECT term, z, sum(cnt * j / mix) + {BETA} AS c FROM e{i} GROUP BY term, z",
        f"wz{i + 1}": f"SELECT term, z, c / sum(c) OVER (PARTITION BY z) AS p FROM wzc{i + 1}",
        f"zdc{i + 1}": f"SELECT doc_id, z, sum(cnt * j / mix) + {ALPHA} AS c FROM e{i} GROUP BY doc_id, z",
        f"zd{i + 1}": f"SELECT doc_id, z, coalesce(c / sum(c) OVER (PARTITION BY doc_id), {1 / K}) AS p FROM documents CROSS JOIN zs LEFT JOIN zdc{i + 1} USING (doc_id, z)",
    }


for _i in range(3):
    CTES |= em(_i)
CTES |= {
    # The model after one iteration, which reports and evaluation are about.
    "pz": f"SELECT z, ({ALPHA} + coalesce(sum(n_words * p), 0)) / ({K} * {ALPHA} + (SELECT sum(n_words) FROM len)) AS p FROM zd1 LEFT JOIN len USING (doc_id) GROUP BY z",
    "pw": "SELECT term, sum(w.p * q.p) AS p FROM wz1 w JOIN pz q USING (z) GROUP BY term",
    "pur": "SELECT z, CASE WHEN sum(p * log2(p)) = 0 THEN 1.0 ELSE power(2.0, sum(p * log2(p)) / sum(p)) END AS purity FROM zd1 WHERE p > 0 GROUP BY z",
    "sco": "SELECT z, p, purity, 100 * p * purity AS score, row_number() OVER (ORDER BY 100 * p * purity DESC, z)::INTEGER AS rank FROM pur JOIN pz USING (z)",
    "wts": "SELECT term, w.z, CASE WHEN w.p * q.p > 0 THEN w.p * q.p * ln(w.p / pw.p) ELSE 0 END AS score FROM wz1 w JOIN pz q ON q.z = w.z JOIN pw USING (term)",
    "truth": "SELECT doc_id, lang AS label FROM documents",
    "jc": "SELECT z, label, sum(n_words * p) AS n FROM zd1 JOIN len USING (doc_id) JOIN truth USING (doc_id) GROUP BY z, label",
    "jd": "SELECT z, label, sum(p) AS n FROM zd1 JOIN truth USING (doc_id) GROUP BY z, label",
    "wd": "SELECT DISTINCT doc_id, lang, source AS domain, term FROM (SELECT doc_id, lang, source, unnest(string_split_regex(text, '\\s+')) AS term FROM documents) WHERE term <> ''",
}


def query(body: str) -> str:
    """body after the subqueries that it needs, in order."""
    need: set[str] = set()
    todo = [body]
    while todo:
        for word in re.findall(r"[a-z_0-9]+", todo.pop()):
            if word in CTES and word not in need:
                need.add(word)
                todo.append(CTES[word])
    used = [f"{k} AS {'MATERIALIZED ' if k != 'zs' else ''}({v})" for k, v in CTES.items() if k in need]
    return (f"WITH {', '.join(used)} " if used else "") + body
