"""SQL that the queries of this subpackage are held against, for DuckDB."""

from __future__ import annotations

from vaktavya.llm import unify
from vaktavya.llm.digest import MANTISSA_BITS, QUANTILES

_PLAIN_ID = r"""
    CASE WHEN regexp_matches(trim(utterance_id, E' \t\n'), '(?i)(^|/)c[0-9]+[_ -]t[0-9]+([.][a-z0-9]+)?$')
    THEN 'c' || lpad(c, CAST(greatest(length(c), 8) AS INTEGER), '0') || '_t' || lpad(t, CAST(greatest(length(t), 4) AS INTEGER), '0')
    ELSE trim(utterance_id, E' \t\n') END
"""


_RANKED = rf"""
    parts AS (
        SELECT *, ltrim(regexp_extract(utterance_id, '(?i)c([0-9]+)[_ -]t[0-9]+', 1), '0') AS c0,
            ltrim(regexp_extract(utterance_id, '(?i)c[0-9]+[_ -]t([0-9]+)', 1), '0') AS t0
        FROM predictions WHERE utterance_id IS NOT NULL AND provider IS NOT NULL
    ), plain AS (
        SELECT row_id, provider, prediction, latency_ms, status, written_at,
            CASE WHEN c0 = '' THEN '0' ELSE c0 END AS c, CASE WHEN t0 = '' THEN '0' ELSE t0 END AS t, utterance_id
        FROM parts
    ), ranked AS (
        SELECT row_id, provider, latency_ms, {_PLAIN_ID} AS id, status, prediction, coalesce(regexp_matches(prediction, '[^\s\p{{Z}}\p{{Cf}}]'), false) AS said,
            coalesce(lower(trim(status)) IN ('success', 'ok'), false) AND coalesce(regexp_matches(prediction, '[^\s\p{{Z}}\p{{Cf}}]'), false) AS done, written_at
        FROM plain
    ), ordered AS (
        SELECT *, row_number() OVER (PARTITION BY id, provider ORDER BY done DESC, written_at DESC NULLS LAST, row_id DESC) AS r FROM ranked
    )"""
_LATENCIES = rf"""
    ids AS (SELECT latency_ms, CAST(written_at AS DATE) AS day, utterance_id, provider, ltrim(regexp_extract(utterance_id, '(?i)c([0-9]+)[_ -]t[0-9]+', 1), '0') AS c0,
        ltrim(regexp_extract(utterance_id, '(?i)c[0-9]+[_ -]t([0-9]+)', 1), '0') AS t0 FROM predictions WHERE latency_ms > 0 AND NOT isnan(latency_ms)),
    spelled AS (SELECT latency_ms AS v, day, utterance_id, CASE WHEN c0 = '' THEN '0' ELSE c0 END AS c, CASE WHEN t0 = '' THEN '0' ELSE t0 END AS t FROM ids),
    named AS (SELECT utterance_id AS id, max(language) AS language, max(domain) AS domain FROM release WHERE utterance_id IS NOT NULL GROUP BY 1),
    known AS (SELECT v, day, language, domain FROM (SELECT v, day, {_PLAIN_ID} AS id FROM spelled) LEFT JOIN named USING (id)),
    powers AS (SELECT *, CAST(floor(log2(v)) AS INTEGER) AS p FROM known),
    exact AS (SELECT * REPLACE (p + CASE WHEN v >= pow(2.0, p + 1) THEN 1 WHEN v < pow(2.0, p) THEN -1 ELSE 0 END AS p) FROM powers),
    leaves AS (SELECT day, language, domain, (1.0::DOUBLE + (floor((v / pow(2.0, p) - 1) * {1 << MANTISSA_BITS}) + 0.5::DOUBLE) / {1 << MANTISSA_BITS}) * pow(2.0, p) AS x FROM exact)"""


def _percentiles(keys: str) -> str:
    """Exact percentiles of leaves: what a digest gives for groups that it doesn't compress."""
    at = ", ".join(f"max(x) FILTER (WHERE r = greatest(1, CAST(ceil({q} * n - 1e-9) AS BIGINT))) AS {name}" for name, q in QUANTILES.items())
    return f"""
        WITH {_LATENCIES}, placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM leaves)
        SELECT {keys}, max(n) AS n, {at}, CAST(0.0 AS DOUBLE) AS rank_error FROM placed GROUP BY {keys}
    """


_SIGNS = unify.viramas()
_PLAIN_JOINER = rf"(^|[^{unify._class(_SIGNS)}])[\x{{200C}}\x{{200D}}]"
_UNSEEN = unify.INVISIBLE.replace(r"\x{200B}-\x{200F}", r"\x{200B}\x{200E}\x{200F}")
_FORMS = unify._class(unify.compatibility()[0] + "".join(unify.compatibility()[2]))
_UNPLAIN = rf"[{_UNSEEN}]|{_PLAIN_JOINER}|[{unify._class(unify.BLANKS + unify.HYPHENS)}]|[{_FORMS}]|{'|'.join(unify.SEQUENCES)}"
_FROM, _TO = "".join(unify.LOOKALIKES.values()), "".join(k * len(v) for k, v in unify.LOOKALIKES.items())
_STANDS_IN = f"(regexp_matches(w, '[{unify.STAND_IN}]') AND NOT regexp_matches(translate(w, '{_FROM}', '{_TO}'), '[{unify.STAND_IN}]'))"
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")

_WHOLE = "n"
for _pair, _one in unify.SEQUENCES.items():
    _WHOLE = f"replace({_WHOLE}, '{_pair}', '{_one}')"
_ONE, _PLAIN = unify.compatibility()[:2]
_TE, _KN = ("".join(map(chr, range(z, z + 0x80))) for z in (0xC00, 0xC80))
_COUNT = lambda cls: f"len(regexp_extract_all(w, '[{cls}]'))"
_TWIN = f"""CASE WHEN {_COUNT(unify.TELUGU)} > 0 AND {_COUNT(unify.KANNADA)} >= {_COUNT(unify.TELUGU)} THEN translate(w, '{_TE}', '{_KN}')
    WHEN {_COUNT(unify.KANNADA)} > 0 AND {_COUNT(unify.TELUGU)} > 0 THEN translate(w, '{_KN}', '{_TE}') ELSE w END"""

#: Words of documents (0) and items (1), and the documents' texts without invisible characters.
_SAID = f"""
    texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, item_id, text FROM eval_items WHERE text IS NOT NULL),
    bare AS (SELECT kind, id, regexp_replace(text, '[{unify.INVISIBLE}]', '', 'g') AS shown FROM texts),
    plain AS (SELECT kind, id, shown, replace(replace(translate(shown, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS t FROM bare),
    said AS (
        SELECT kind, id, shown, list_transform(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: CASE WHEN {_STANDS_IN} THEN translate(w, '{_FROM}', '{_TO}') ELSE w END), lambda w: lower(nfc_normalize(w))) AS l
        FROM plain
    )"""

SQL: dict[str, str] = {
    "p3_found": f"""
        WITH {_RANKED}
        SELECT id AS utterance_id, provider, CAST(min_by(row_id, r) AS BIGINT) AS prediction_row,
            CAST(coalesce(min_by(row_id, r) FILTER (WHERE latency_ms > 0), -1) AS BIGINT) AS latency_row
        FROM ordered GROUP BY id, provider HAVING count(*) > 1
    """,
    "p3_survivors": f"""
        WITH {_RANKED}
        SELECT id AS utterance_id, provider, count(*) AS n_records, CAST(min_by(row_id, r) AS BIGINT) AS prediction_row, min_by(prediction, r) FILTER (WHERE said) AS prediction,
            min_by(status, r) FILTER (WHERE regexp_matches(status, '[^\\s\\p{{Z}}\\p{{Cf}}]')) AS status, min_by(written_at, r) FILTER (WHERE written_at IS NOT NULL) AS written_at,
            CAST(coalesce(min_by(row_id, r) FILTER (WHERE latency_ms > 0), -1) AS BIGINT) AS latency_row, min_by(latency_ms, r) FILTER (WHERE latency_ms > 0) AS latency_ms
        FROM ordered GROUP BY id, provider
    """,
    "p5_daily": _percentiles("language, domain, day"),
    "p5_total": _percentiles("language, domain"),
    "p5_coarse": f"WITH {_LATENCIES} SELECT language, count(*) AS n, true AS kept FROM known WHERE language IS NOT NULL GROUP BY language",
    "p6_found": f"""
        WITH texts AS (
            SELECT 'release' AS source_table, utterance_id AS record_id, transcription AS t FROM release
            UNION ALL SELECT 'predictions', CAST(row_id AS VARCHAR), prediction FROM predictions
        )
        SELECT DISTINCT source_table, record_id FROM texts WHERE regexp_matches(t, '{_UNPLAIN}') OR t <> nfc_normalize(t)
            OR len(list_filter(string_split(t, ' '), lambda w: {_STANDS_IN} OR (regexp_matches(w, '[{unify.TELUGU}]') AND regexp_matches(w, '[{unify.KANNADA}]')))) > 0
    """,
    "p6_unified": f"""
        WITH texts AS (
            SELECT 'release' AS source_table, utterance_id AS record_id, transcription AS t FROM release
            UNION ALL SELECT 'predictions', CAST(row_id AS VARCHAR), prediction FROM predictions
        ),
        shown AS (SELECT *, regexp_replace(t, '([{unify._class(_SIGNS)}][\\x{{200C}}\\x{{200D}}])|[{unify.INVISIBLE}]', '\\1', 'g') AS a FROM texts),
        spaced AS (SELECT *, translate(a, '{unify.BLANKS + unify.HYPHENS}', '{' ' * len(unify.BLANKS) + '-' * len(unify.HYPHENS)}') AS b FROM shown),
        plain AS (SELECT *, replace(replace(translate(b, '{_ONE.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS c FROM spaced),
        own AS (SELECT *, array_to_string(list_transform(list_transform(string_split(c, ' '), lambda w: CASE WHEN {_STANDS_IN} THEN translate(w, '{_FROM}', '{_TO}') ELSE w END), lambda w: {_TWIN}), ' ') AS d FROM plain),
        composed AS (SELECT source_table, record_id, nfc_normalize(d) AS n FROM own)
        SELECT source_table, record_id, {_WHOLE} AS text_unified FROM composed
    """,
    "p9_found": f"""
        WITH {_SAID}, grams AS (SELECT DISTINCT kind, id, array_to_string(l[i:i + 9], ' ') AS g FROM (SELECT kind, id, l, unnest(range(1, len(l) - 8)) AS i FROM said))
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i USING (g) WHERE d.kind = 0 AND i.kind = 1
    """,
    "p9_clean": f"""
        WITH {_SAID}, grams AS (SELECT kind, id, i, array_to_string(l[i:i + 9], ' ') AS g FROM (SELECT kind, id, l, unnest(range(1, len(l) - 8)) AS i FROM said)),
        items AS (SELECT DISTINCT id, g FROM grams WHERE kind = 1),
        hits AS (SELECT d.id AS doc_id, i.id AS item_id, d.i FROM grams d JOIN items i USING (g) WHERE d.kind = 0),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 10)) AS w FROM hits),
        -- what stands between two words goes if both are in one span or in spans that touch
        between AS (SELECT DISTINCT a.doc_id, a.w FROM gone a JOIN gone b ON a.doc_id = b.doc_id AND b.w = a.w + 1),
        cut AS (SELECT id AS doc_id, regexp_extract_all(shown, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+') AS l FROM said WHERE kind = 0 AND id IN (SELECT doc_id FROM hits)),
        pieces AS (SELECT doc_id, generate_subscripts(l, 1) AS j, unnest(l) AS x FROM cut),
        counted AS (SELECT *, regexp_matches(x, '^[\\p{{L}}\\p{{M}}\\p{{N}}]') AS word, sum(CASE WHEN regexp_matches(x, '^[\\p{{L}}\\p{{M}}\\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY j) AS w FROM pieces),
        left_ AS (
            SELECT c.doc_id, string_agg(x, '' ORDER BY j) AS clean_text FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.w = c.w LEFT JOIN between b ON b.doc_id = c.doc_id AND b.w = c.w
            WHERE CASE WHEN word THEN g.w IS NULL ELSE b.w IS NULL END GROUP BY c.doc_id
        ),
        found AS (SELECT doc_id, item_id, CAST(count(DISTINCT i) AS INTEGER) AS n_windows FROM hits GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_windows, coalesce(clean_text, '') AS clean_text FROM found LEFT JOIN left_ USING (doc_id)
    """,
}
