"""SQL that each of the core's queries is held against, by name: written for DuckDB, apart from the expressions of the queries."""

from __future__ import annotations

from vaktavya.functions.plain import JOINERS, VIRAMAS
from vaktavya.functions.vocabulary import BEFORE_SECOND, ORDINALS, SCALES, SPELLINGS, TENS, UNITS, words
from vaktavya.operators.scoring import COUNTS, POISSON_BOUNDS
from vaktavya.semantic import sounds
from vaktavya.sources.records import STATUSES

_LIST = lambda some: ", ".join(f"'{w}'" for w in some)
_TEXT = r"""("([^"]|"")*"|[^",\r\n]*)"""
_SOUND = ",".join(
    [
        r"""("c[0-9]+_t[0-9]+"|c[0-9]+_t[0-9]+)""",
        _TEXT,
        r"""("([0-9]+(\.[0-9]+)?)?"|([0-9]+(\.[0-9]+)?)?)""",
        r"""(?i:"(success|ok|error|timeout|rate_limited|missing_audio)"|(success|ok|error|timeout|rate_limited|missing_audio))""",
        _TEXT,
    ]
)

_PARTS = r"[,，、،;；|｜\r\n\t•·‣▪●\x02]"
_BARE = r"regexp_replace(keywords, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_NO_WRAP = rf"CASE WHEN regexp_full_match({_BARE}, '(?s)\[.*\]|\(.*\)|\{{.*\}}|<.*>') THEN {_BARE}[2:-2] ELSE {_BARE} END"
_COMMAS = r"'(\d),(\d)', '\1' || chr(1) || '\2', 'g'"
#: A cell without brackets; commas between digits are hidden, slashes beside a blank marked.
_HIDDEN = rf"regexp_replace(regexp_replace(regexp_replace({_NO_WRAP}, {_COMMAS}), {_COMMAS}), '(\s)/|/(\s)', '\1' || chr(2) || '\2', 'g')"
_QUOTES = r"""“[^”]*”|‘[^’]*’|«[^»]*»|`[^`]*`|''(?:[^'']|'''')*''"""
_ITEM = rf"""[\s\p{{Z}}]*("(?:[^"]|"")*"|{_QUOTES}|[^{_PARTS[1:-1]}]*)[\s\p{{Z}}]*{_PARTS}"""
#: An item without its quotes.
_TAKEN = rf"""CASE WHEN regexp_full_match(x, '(?s)".+"') THEN replace(x[2:-2], '""', '"') WHEN regexp_full_match(x, '(?s){_QUOTES}') AND length(x) > 1 THEN x[2:-2] ELSE x END"""

_QUOTED = r"""([^"\r\n,]*|"([^"]|"")*")([,\r\n]([^"\r\n,]*|"([^"]|"")*"))*"""
#: The fields of a record, quotes taken off.
_RECORDS = r"""(
    SELECT *, list_transform(regexp_extract_all(raw_line || ',', '("(?:[^"]|"")*"|[^,"]*),', 1),
        lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
    FROM raw_predictions
)"""

_RELEASE = "(SELECT DISTINCT * FROM release)"
_CLEAN = r"regexp_replace(utterance_id, '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g')"
_IS_ID = rf"regexp_matches({_CLEAN}, '(?i)(^|[/\\])c[0-9]+[_ -]t[0-9]+([.][a-z0-9]+)?$')"


def _pad(group: int, width: int) -> str:
    digits = rf"regexp_replace(regexp_extract({_CLEAN}, '(?i)c([0-9]+)[_ -]t([0-9]+)([.][a-z0-9]+)?$', {group}), '^0+([0-9])', '\1')"
    return f"lpad({digits}, CAST(greatest(length({digits}), {width}) AS INTEGER), '0')"


_ID = f"CASE WHEN {_IS_ID} THEN 'c' || {_pad(1, 8)} || '_t' || {_pad(2, 4)} ELSE {_CLEAN} END"
_ATTEMPTS = f"""(
    SELECT row_id, provider, prediction, {_ID} AS utterance_id, trim(status) AS status,
        coalesce(lower(trim(status)) IN ('success', 'ok'), false) AS good
    FROM predictions
)"""
_BEST = f"""(
    SELECT * FROM {_ATTEMPTS}
    QUALIFY row_number() OVER (PARTITION BY coalesce(provider || chr(31), '') || coalesce(utterance_id, '') ORDER BY good DESC, row_id DESC) = 1
)"""
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def _folded(text: str) -> str:
    """SQL of the folded text; of the compatibility forms, those that the tables hold."""
    ascii_ = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    digits = "".join(chr(z + d) for z in (0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66) for d in range(10))
    plain = f"nfc_normalize(replace(replace(translate(coalesce({text}, ''), '{_WIDE}', '{ascii_}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
    spoken = f"lower(translate({plain}, '{digits}''’ʼ´`' || chr(8204) || chr(8205), '{'0123456789' * 9}'))"
    spoken = f"replace(replace(replace({spoken}, '%', ' percent '), '₹', ' rupees '), '$', ' dollars ')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({spoken}, '[\p{{P}}\p{{Z}}]', ' ', 'g'), '(\p{{Sc}})', ' \1 ', 'g'), '[\s\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'))"


def _words(text: str) -> str:
    return f"list_filter(string_split({_folded(text)}, ' '), lambda w: w <> '')"


_DISTANCE = """list_reduce(r, lambda prev, t: list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(range(1, j + 1),
    lambda k: j - k + CASE WHEN k = 1 THEN prev[1] + 1 ELSE least(prev[k] + 1, prev[k - 1] + CASE WHEN h[k - 1] = t THEN 0 ELSE 1 END) END))),
    range(0, len(h) + 1))"""
_COUNTED = f"""(
    SELECT provider, utterance_id, language, domain,
        CAST(CASE WHEN len(r) = 0 THEN 0 ELSE list_extract({_DISTANCE}, -1) END AS BIGINT) AS edits, CAST(len(r) AS BIGINT) AS units
    FROM (
        SELECT provider, utterance_id, language, domain, {_words('transcription')} AS r, {_words('prediction')} AS h
        FROM {_BEST} JOIN {_RELEASE} USING (utterance_id)
    )
)"""

_MAP = lambda table: "MAP {" + ", ".join(f"'{k}': {v if isinstance(v, int) else repr(v)}" for k, v in table.items()) + "}"
_VALUES = {**words(UNITS), **words(TENS), **words(SCALES)}
_CLASS = f"""CASE WHEN regexp_full_match(o, '\\p{{Nd}}+') THEN 'D' WHEN o IN ({_LIST(w for w, v in words(UNITS).items() if v < 10)}) THEN 'U'
    WHEN o IN ({_LIST(w for w, v in words(UNITS).items() if v > 9)}) THEN 'N' WHEN o IN ({_LIST(words(TENS))}) THEN 'X'
    WHEN o IN ({_LIST(words(SCALES))}) THEN 'S' WHEN o = 'and' THEN 'A' ELSE 'O' END"""
_SETTLE_SOUND = r"""regexp_replace(regexp_replace(regexp_replace(w, '^h*m{2,}$', 'hmm'), '^a+h+$', 'ah'), '^h+a+$', 'ha')"""
_DIGITS = lambda text: f"array_to_string(regexp_extract_all({text}, '.'), ' ')"


def _settled(word: str) -> str:
    sound = _SETTLE_SOUND.replace("(w,", f"({word},")
    return f"coalesce(map_extract_value({_MAP(SPELLINGS)}, {sound}), {sound})"


def _forms(texts: str) -> str:
    """Common tables up to forms (t, n, s, c): the normal form of each text t of ``texts``, the one with numbers as spoken, and that without spellings.

    Numbers are found without a state: a word goes on with a number if the last word that isn't ``and`` allows it; a number's value is
    a sum of words, each times the hundreds after it up to the next larger scale.
    """
    return f"""
    texts AS (SELECT DISTINCT t FROM ({texts}) WHERE t IS NOT NULL),
    tok AS (SELECT t, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT t, {_words('t')} AS l FROM texts)),
    near AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY t ORDER BY i), '') AS before FROM tok),
    cardinal AS (
        SELECT t, i, w, CASE WHEN regexp_full_match(w, '[0-9]+(st|nd|rd|th)') THEN regexp_extract(w, '^[0-9]+')
            WHEN w = 'second' AND NOT (before IN ({_LIST([*words(UNITS), *BEFORE_SECOND])}) OR regexp_full_match(before, '\\p{{Nd}}+')) THEN 'two'
            ELSE coalesce(map_extract_value({_MAP(ORDINALS)}, w), w) END AS o FROM near
    ),
    sides AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY t ORDER BY i), '') AS a, coalesce(lead(o) OVER (PARTITION BY t ORDER BY i), '') AS b FROM cardinal),
    kinds AS (
        SELECT t, i, o, {_CLASS} AS k FROM sides
        WHERE NOT (o = 'point' AND (a IN ({_LIST(_VALUES)}) OR regexp_full_match(a, '\\p{{Nd}}+')) AND (b IN ({_LIST(_VALUES)}) OR regexp_full_match(b, '\\p{{Nd}}+')))
    ),
    nexts AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY t ORDER BY i), '') AS after FROM kinds),
    solid AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY t ORDER BY i), '') AS p FROM nexts WHERE k <> 'A'),
    members AS (SELECT *, k IN ('U', 'N', 'X', 'S') OR (k = 'D' AND (after = 'S' OR p = 'S')) AS m FROM solid),
    joined AS (SELECT *, m AND coalesce(lag(m) OVER (PARTITION BY t ORDER BY i), false) AND (k = 'S' OR p = 'S' OR (p = 'X' AND k = 'U')) AS on_ FROM members),
    runs AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY t ORDER BY i) AS run FROM joined),
    valued AS (
        SELECT t, i, run, k, CASE WHEN k = 'D' THEN CAST(o AS HUGEINT) ELSE CAST(map_extract_value({_MAP(_VALUES)}, o) AS HUGEINT) END AS v
        FROM runs WHERE m
    ),
    parts AS (SELECT *, coalesce(sum(CASE WHEN k = 'S' AND v <> 100 THEN 1 ELSE 0 END) OVER (PARTITION BY t, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM valued),
    hundreds AS (
        SELECT *, k = 'S' AND v = 100 AS h, sum(CASE WHEN k = 'S' AND v = 100 THEN 1 ELSE 0 END) OVER (PARTITION BY t, run, part ORDER BY i) AS seen,
            sum(CASE WHEN k = 'S' AND v = 100 THEN 1 ELSE 0 END) OVER (PARTITION BY t, run, part) AS total FROM parts
    ),
    sums AS (
        SELECT t, run, part, min(i) AS i, max(CASE WHEN k = 'S' AND NOT h THEN v END) AS scale,
            sum(CASE WHEN k = 'S' THEN 0 ELSE v * CAST(pow(100, total - seen) AS HUGEINT) END)
            + CASE WHEN max(total) > 0 AND coalesce(sum(CASE WHEN k <> 'S' AND seen = 0 THEN v END), 0) = 0 THEN CAST(pow(100, max(total)) AS HUGEINT) ELSE 0 END AS v
        FROM hundreds GROUP BY t, run, part
    ),
    numbers AS (SELECT t, min(i) AS i, sum(CASE WHEN scale IS NULL THEN v WHEN v = 0 THEN scale ELSE v * scale END) AS v FROM sums GROUP BY t, run),
    ands AS (
        SELECT t, i FROM (
            SELECT n.t, n.i, n.k, first_value(r.on_ IGNORE NULLS) OVER (PARTITION BY n.t ORDER BY n.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS kept
            FROM nexts n LEFT JOIN runs r USING (t, i)
        ) WHERE k = 'A' AND NOT coalesce(kept, false)
    ),
    pieces AS (
        SELECT t, i, {_DIGITS('CAST(v AS VARCHAR)')} AS x, {_DIGITS('CAST(v AS VARCHAR)')} AS y FROM numbers
        UNION ALL SELECT t, i, 'and', 'and' FROM ands
        UNION ALL SELECT t, i, CASE WHEN k = 'D' THEN {_DIGITS('o')} ELSE o END, CASE WHEN k = 'D' THEN {_DIGITS('o')} ELSE {_settled('o')} END FROM runs WHERE NOT m
    ),
    composed AS (SELECT t, string_agg(y, ' ' ORDER BY i) AS n, string_agg(x, ' ' ORDER BY i) AS c FROM pieces GROUP BY t),
    spoken AS (SELECT t, string_agg({_settled('w')}, ' ' ORDER BY i) AS s FROM tok GROUP BY t),
    forms AS (SELECT t, coalesce(n, '') AS n, coalesce(s, '') AS s, coalesce(c, '') AS c FROM texts LEFT JOIN composed USING (t) LEFT JOIN spoken USING (t))
    """


_SPLIT = lambda text: f"list_filter(string_split({text}, ' '), lambda w: w <> '')"
_JOINS = f"{VIRAMAS}{JOINERS}"
_CLUSTER = rf"(?s)(?:[{_JOINS}]*[^{_JOINS}]|[{_JOINS}]+)(?:[{_JOINS}]+[^{_JOINS}]|[{_JOINS}]+|\p{{M}})*"
_MIXED = lambda text: f"flatten(list_transform({_SPLIT(text)}, lambda w: CASE WHEN regexp_matches(w, '[a-z\\p{{Nd}}]') THEN [w] ELSE regexp_extract_all(w, '{_CLUSTER}') END))"


def _edits(r: str, h: str) -> str:
    """Distance of two lists: by one byte a unit where there are few enough, else by rows of the table of distances."""
    coded = lambda l: f"array_to_string(list_transform({l}, lambda u: chr(CAST(list_position(v, u) AS INTEGER))), '')"
    table = _DISTANCE.replace("list_reduce(r,", f"list_reduce({r},").replace("len(h)", f"len({h})").replace("h[k - 1]", f"{h}[k - 1]")
    return f"""CAST((SELECT CASE WHEN len({r}) = 0 THEN 0 WHEN len({h}) = 0 THEN len({r}) WHEN len(v) < 127 THEN levenshtein({coded(r)}, {coded(h)})
        ELSE list_extract({table}, -1) END FROM (SELECT list_distinct(list_concat({r}, {h})) AS v)) AS BIGINT)"""


_ITEMS = f"""
    cells AS (SELECT DISTINCT keywords FROM release WHERE lower(regexp_replace(keywords, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'nan', 'none')),
    items AS (
        SELECT keywords, replace(x, chr(1), ',') AS t, i FROM (
            SELECT keywords, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (
                SELECT keywords, regexp_split_to_array(regexp_replace(regexp_replace(keywords, '(\\p{{Nd}}),(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g'),
                    '(\\p{{Nd}}),(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g'), '\\n+|,') AS l FROM cells))
    ),
"""
_SUFFIX = "|".join(rf"[^ A-Za-z]{{0,{k}}}[^ \x00-\x7F][^ A-Za-z]{{0,{5 - k}}}" for k in range(6))


def _says(text: str) -> str:
    """Whether a text says a keyword k: whole words, the last perhaps with an ending."""
    short = "length(regexp_extract(k, '[^ ]*$')) < 3"
    return f"regexp_matches({text}, '(^| )' || regexp_escape(k) || CASE WHEN {short} THEN '' ELSE '(s|es|{_SUFFIX})?' END || '( |$)')"


def _scored(answers: str) -> str:
    """Common tables up to counted: all counts of the rows of ``answers`` that answer a released utterance."""
    return f"""WITH {_ITEMS}
    {_forms("SELECT transcription AS t FROM release UNION ALL SELECT prediction FROM predictions UNION ALL SELECT t FROM items")},
    rows_ AS (
        SELECT provider, utterance_id, call_id, language, domain, coalesce(prediction, '') AS prediction, keywords, coalesce(a.n, '') AS rn, coalesce(a.s, '') AS rs, coalesce(b.n, '') AS hn, coalesce(b.s, '') AS hs
        FROM {answers} JOIN {_RELEASE} USING (utterance_id) LEFT JOIN forms a ON a.t = transcription LEFT JOIN forms b ON b.t = prediction
    ),
    named AS (SELECT keywords, n, arg_min(s, i) AS s FROM items JOIN forms USING (t) WHERE n <> '' GROUP BY keywords, n),
    asked AS (SELECT DISTINCT keywords, rn, rs, hn, hs FROM rows_ WHERE keywords IS NOT NULL),
    told AS (
        SELECT keywords, rn, rs, hn, hs, n, bool_or({_says('rn')} OR {_says('rs')}) AS r, bool_or({_says('hn')} OR {_says('hs')}) AS h
        FROM (SELECT a.*, n, unnest([n, s]) AS k FROM asked a JOIN named USING (keywords)) GROUP BY ALL
    ),
    kept AS (SELECT keywords, rn, rs, hn, hs, count(*) FILTER (WHERE r AND h) AS hits, count(*) FILTER (WHERE r) AS total FROM told GROUP BY ALL),
    units AS (
        SELECT rn, hn, {_SPLIT('rn')} AS rw, {_SPLIT('hn')} AS hw, regexp_extract_all(rn, '(?s).') AS rc, regexp_extract_all(hn, '(?s).') AS hc, {_MIXED('rn')} AS rm, {_MIXED('hn')} AS hm
        FROM (SELECT DISTINCT rn, hn FROM rows_)
    ),
    edits AS (
        SELECT rn, hn, {_edits('rw', 'hw')} AS w_edits, len(rw) AS w_units, {_edits('rc', 'hc')} AS c_edits, len(rc) AS c_units, {_edits('rm', 'hm')} AS m_edits, len(rm) AS m_units FROM units
    ),
    counted AS (
        SELECT provider, utterance_id, call_id, language, domain, w_edits, w_units, c_edits, c_units, m_edits, m_units, coalesce(hits, 0) AS kw_hits, coalesce(total, 0) AS kw_total,
            CAST(regexp_full_match(prediction, '[\\s\\p{{Z}}]*') AS BIGINT) AS empty_hyp
        FROM rows_ r JOIN edits e ON e.rn = r.rn AND e.hn = r.hn
            LEFT JOIN kept k ON k.keywords = r.keywords AND k.rn = r.rn AND k.rs = r.rs AND k.hn = r.hn AND k.hs = r.hs
    )
"""


_SCORED = _scored(_BEST)
_RATE = lambda e, u: f"CASE WHEN sum({u}) > 0 THEN CAST(sum({e}) AS DOUBLE) / CAST(sum({u}) AS DOUBLE) END"
_FIGURES = f"""count(*) AS utterances, CAST(sum(w_units) AS BIGINT) AS reference_words, {_RATE('w_edits', 'w_units')} AS wer, {_RATE('c_edits', 'c_units')} AS cer,
    {_RATE('m_edits', 'm_units')} AS mer, 1 - {_RATE('kw_hits', 'kw_total')} AS kwer, CAST(sum(kw_total) AS BIGINT) AS keywords_scored, CAST(sum(empty_hyp) AS BIGINT) AS empty_hypotheses"""
#: Weights of 200 resamples for each row of totals, whose column h is the call's hash.
_CALL_HASH = "CAST('0x' || substr(sha1(call_id), 1, 8) AS BIGINT)"
_WEIGHED = f"""
    seeded AS (SELECT *, xor(h, (boot * 2654435769 + 20260916) & 4294967295) AS x FROM totals, range(200) b(boot)),
    once AS (SELECT * REPLACE (CAST((CAST(xor(x, x >> 16) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS x) FROM seeded),
    twice AS (SELECT * REPLACE (CAST((CAST(xor(x, x >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS x) FROM once),
    mixed AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM twice),
    weighed AS (SELECT *, {' + '.join(f'CAST(x >= {int(b)} AS BIGINT)' for b in POISSON_BOUNDS)} AS w FROM mixed)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
_CODES = "list_sort(list_distinct(list_filter(string_split(translate(lower(trim(coalesce(language_tag, ''))), '_', '-'), '-'), lambda c: c <> '')))"
_CODE = "lower(trim(coalesce(language, '')))"
_SCRIPTS = {"Devanagari": 0x900, "Bengali": 0x980, "Gurmukhi": 0xA00, "Gujarati": 0xA80, "Oriya": 0xB00, "Tamil": 0xB80, "Telugu": 0xC00, "Kannada": 0xC80, "Malayalam": 0xD00}
_BLOCK = lambda text: "CASE " + " ".join(f"WHEN regexp_matches({text}, '^\\P{{L}}*\\p{{{name}}}') THEN {base}" for name, base in _SCRIPTS.items()) + f" WHEN regexp_matches({text}, '\\p{{L}}') THEN 0 END"
_PLACES = {
    **{p: f"{c}\x01" for p, c in sounds.CONSONANTS.items()}, **{p: f"\x02{v}" for p, v in sounds.VOWEL_SIGNS.items()}, sounds.VIRAMA: "\x02", **sounds.VOWELS, **sounds.SIGNS,
}
_PLACE_MAP = "MAP {" + ", ".join(f"{p}: '{v}'" for p, v in _PLACES.items()) + "}"
_CHILLUS = "w"
for _chillu, _spelled in (*sounds.CHILLUS.items(), sounds.DOUBLED_T):
    _CHILLUS = f"replace({_CHILLUS}, '{_chillu}', '{_spelled}')"
_ONCE = lambda text: f"array_to_string(list_filter(string_split({text}, ''), lambda c, i: i = 1 OR c = ' ' OR c <> {text}[i - 1]), '')"
_LCS = lambda a, b: f"""list_extract(list_reduce(string_split({a}, ''), lambda prev, c: list_transform(range(1, len(string_split({b}, '')) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(prev[k], (CASE WHEN k = 1 THEN 0 ELSE prev[k - 1] END) + CASE WHEN {b}[k] = c THEN 1 ELSE 0 END)))), list_transform(range(0, length({b})), lambda x: CAST(0 AS BIGINT))), -1)"""  # noqa: E731
_LIKE = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * {_LCS(a, b)} / (length({a}) + length({b})) END"
_SKELETONS = lambda a, b, least: f"({a} <> '' AND {b} <> '' AND CASE WHEN greatest(length({a}), length({b})) <= 3 THEN {a} = {b} ELSE {_LIKE(a, b)} >= {least} END)"
_HAS_DIGITS = lambda text: f"regexp_matches({text}, '(^| )\\p{{Nd}}+( |$)')"
_DIGITS_OF = lambda text: f"array_to_string(list_filter(string_split({text}, ' '), lambda w: regexp_full_match(w, '\\p{{Nd}}+')), '')"
_REST_OF = lambda text: f"array_to_string(list_filter(string_split({text}, ' '), lambda w: NOT regexp_full_match(w, '\\p{{Nd}}+')), ' ')"
_KEYS = f"""
    words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(t, ' ')) AS w FROM spans) WHERE w <> ''),
    blocks AS (SELECT w, {_BLOCK('w')} AS b FROM words),
    spelled AS (
        SELECT w, b, CASE WHEN b > 0 THEN array_to_string(list_transform(string_split(CASE WHEN b = {0xD00} THEN {_CHILLUS} ELSE w END, ''),
                lambda c: CASE WHEN b = {0x980} AND unicode(c) = {0x980 + sounds.BENGALI_B} THEN 'v\x01' ELSE coalesce(map_extract_value({_PLACE_MAP}, unicode(c) - b), c) END), '')
            ELSE regexp_replace(regexp_replace(lower(w), 'c([eiy])', 's\\1', 'g'), '([aeiou])w$', '\\1') END AS x FROM blocks
    ),
    said AS (SELECT w, b, regexp_replace(strip_accents(lower(replace(replace(replace(x || CASE WHEN b > 0 THEN '\x03' ELSE '' END, '\x01\x02', ''), '\x01', 'a'), '\x02', ''))), '[^a-z0-9]', '', 'g') AS l FROM spelled),
    placed AS (SELECT t, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT t, string_split(t, ' ') AS ws FROM spans WHERE t <> '')),
    latin AS (
        SELECT t, coalesce(string_agg(l, ' ' ORDER BY i) FILTER (WHERE l <> ''), '') AS l, list_sort(list_distinct(list(b) FILTER (WHERE b IS NOT NULL))) AS bs, count(*) AS n, arg_min(b, i) FILTER (WHERE b IS NOT NULL) AS b
        FROM placed JOIN said USING (w) GROUP BY t
    ),
    coarse AS (
        SELECT *, {_ONCE('k')} AS ph FROM (SELECT *, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(l, '[0-9]', '', 'g'), 'ph', 'f'),
            'ch', chr(4)), 'c', 'k'), chr(4), 'c'), 'q', 'k'), 'x', 'ks'), 'w', 'v'), 'z', 'j'), '([bcdfgjklmnpqrstvxy])h', '\\1', 'g') AS k FROM latin)
    ),
    bare AS (
        SELECT *, replace(ph, ' ', '') AS p0, regexp_replace(translate(replace(ph, ' ', ''), 'cjgdbfvmy', 'ssktpppn'), '[aeiou]', '', 'g') AS s0,
            regexp_extract_all(regexp_replace(replace(replace(replace(replace(l, ' ', ''), 'ph', 'f'), 'm', 'n'), 'y', ''), '[aeiou]', '', 'g'), '[a-z]h?|[0-9]') AS us,
            replace(regexp_extract(l, '[^ ]*$'), 'm', 'n') AS last FROM coarse
    ),
    ended AS (SELECT *, {_ONCE('s0')} AS sk, array_to_string(list_filter(us, lambda u, i: NOT coalesce(us[i + 1][1] = u[1] AND (us[i + 1] = u OR length(u) = 1), false)), '') AS own,
        regexp_extract(CASE WHEN length(last) > 2 THEN regexp_replace(last, 'a$', '') ELSE last END, '[aeiou]*n?$') AS e0 FROM bare),
    heard AS (SELECT t, l, bs, n, b, ph, replace(ph, ' ', '') AS p, sk, own, CASE WHEN b = {0x980} THEN CASE WHEN replace(e0, 'a', '') = 'o' THEN '' ELSE replace(e0, 'a', '') END ELSE e0 END AS ending FROM ended),
    english AS (
        SELECT t, string_agg(map_extract_value({_MAP(sounds.ENGLISH_NUMBERS)}, {_ONCE('y')}), ' ' ORDER BY i) AS said, count(*) AS n, count(map_extract_value({_MAP(sounds.ENGLISH_NUMBERS)}, {_ONCE('y')})) AS known FROM (
            SELECT t, i, CASE WHEN length(x) > 2 THEN regexp_replace(x, 'a$', '') ELSE x END AS y FROM (
                SELECT t, i, regexp_replace(replace(regexp_replace(replace(replace(replace(replace(x, 'ph', 'f'), 'bh', 'v'), 'vh', 'v'), 'jh', 'z'), '^j(iro)', 'z\\1'), 'th', 't'), 'm([dtkgpb])', 'n\\1', 'g') AS x
                FROM (SELECT t, generate_subscripts(string_split(l, ' '), 1) AS i, unnest(string_split(l, ' ')) AS x FROM heard)
            )
        ) GROUP BY t
    ),
    readings AS (SELECT t, t AS reading FROM heard UNION SELECT t, l FROM heard UNION SELECT t, said FROM english WHERE n = known),
    read AS (WITH {_forms("SELECT reading AS t FROM readings")} SELECT r.t, f.n FROM readings r JOIN forms f ON f.t = r.reading)
"""
_HES = _LIST(sounds.HESITATIONS)
_ONE_SCRIPT = f"CASE WHEN a.own <> z.own THEN 'a consonant differs' WHEN a.b IN ({0x900}, {0x980}, {0xA80}) AND a.ending <> z.ending THEN 'the ending differs, which is grammar' ELSE 'ok' END"
_ACROSS = f"CASE WHEN {_SKELETONS('a.sk', 'z.sk', 75)} OR ({_LIKE('a.p', 'z.p')} >= 60 AND {_SKELETONS('a.sk', 'z.sk', 50)}) THEN 'ok' ELSE 'sounds differ' END"
#: Pairs (kind, h, r) of normal spans and why each is accepted ('ok') or not.
_VERDICTS = f"""
    raw AS (SELECT DISTINCT lower(trim(coalesce(e.type, ''))) AS kind, coalesce(e.hypothesis_span, '') AS x, coalesce(e.reference_span, '') AS y FROM (SELECT unnest(response.equivalences) AS e FROM judge_cache)),
    normal AS (WITH {_forms("SELECT x AS t FROM (SELECT e.hypothesis_span AS x FROM (SELECT unnest(response.equivalences) AS e FROM judge_cache) UNION SELECT e.reference_span FROM (SELECT unnest(response.equivalences) AS e FROM judge_cache))")} SELECT t, n FROM forms),
    pairs AS (SELECT DISTINCT kind, x, y, coalesce(f.n, '') AS h, coalesce(g.n, '') AS r FROM raw LEFT JOIN normal f ON f.t = x LEFT JOIN normal g ON g.t = y),
    spans AS (SELECT h AS t FROM pairs UNION SELECT r FROM pairs),
    {_KEYS},
    sided AS (
        SELECT p.*, {_HAS_DIGITS('h')} AS hd, {_HAS_DIGITS('r')} AS rd, CASE WHEN {_HAS_DIGITS('h')} THEN h ELSE r END AS figures, CASE WHEN {_HAS_DIGITS('h')} THEN r ELSE h END AS spoken FROM pairs p
    ),
    same AS (SELECT DISTINCT figures, spoken FROM sided JOIN read ON read.t = spoken WHERE hd <> rd AND {_DIGITS_OF('read.n')} = {_DIGITS_OF('figures')} AND {_REST_OF('read.n')} = {_REST_OF('figures')}),
    verdicts AS (
        SELECT kind, x, y, h, r, CASE
            WHEN kind NOT IN ('script', 'spelling', 'split_join', 'number', 'filler') THEN 'unknown kind'
            WHEN h = r THEN 'spans are the same'
            WHEN kind = 'filler' THEN CASE WHEN h <> '' AND r <> '' THEN 'a filler stands on one side only'
                WHEN len(list_filter(string_split(coalesce(a.ph, z.ph), ' '), lambda w: w NOT IN ({_HES}))) = 0 THEN 'ok' ELSE 'not a hesitation' END
            WHEN h = '' OR r = '' THEN 'a span is empty'
            WHEN kind = 'number' THEN CASE WHEN hd = rd THEN 'a number pair has digits on exactly one side' WHEN len(string_split(s.spoken, ' ')) > 8 THEN 'too many number words'
                WHEN m.spoken IS NOT NULL THEN 'ok' ELSE 'value can''t be verified' END
            WHEN hd OR rd THEN 'digits outside of a number pair'
            WHEN kind = 'split_join' THEN CASE WHEN a.n = z.n THEN 'a split has differing word counts' WHEN replace(h, ' ', '') = replace(r, ' ', '') THEN 'ok'
                WHEN len(list_filter(list_distinct(list_concat(a.bs, z.bs)), lambda b: b > 0)) > 1 THEN 'two Indic scripts'
                WHEN len(list_filter(list_concat(a.bs, z.bs), lambda b: b > 0)) = 0 THEN 'joined forms differ'
                WHEN NOT list_contains(list_concat(a.bs, z.bs), 0) THEN {_ONE_SCRIPT}
                WHEN {_SKELETONS('a.sk', 'z.sk', 90)} AND {_LIKE('a.p', 'z.p')} >= 80 THEN 'ok' ELSE 'joined forms differ' END
            WHEN abs(a.n - z.n) > 1 THEN 'word counts differ too much'
            WHEN a.b IS DISTINCT FROM z.b AND coalesce(a.b, -1) <> 0 AND coalesce(z.b, -1) <> 0 THEN 'two Indic scripts'
            WHEN kind = 'script' THEN CASE WHEN a.b IS NOT DISTINCT FROM z.b THEN 'a script pair in one script' ELSE {_ACROSS} END
            WHEN a.b IS DISTINCT FROM z.b THEN 'a spelling pair across scripts'
            WHEN a.b = 0 THEN 'Latin spellings are the normalizer''s'
            ELSE {_ONE_SCRIPT} END AS reason
        FROM sided s LEFT JOIN heard a ON a.t = h LEFT JOIN heard z ON z.t = r LEFT JOIN same m ON m.figures = s.figures AND m.spoken = s.spoken
    )
"""

#: Semantic counts of rows with an answer. A verified pair is applied to all places at once, which is what one pair of words a row needs.
_SEMANTIC = f"""WITH {_forms("SELECT transcription AS t FROM release UNION ALL SELECT prediction FROM predictions")}, {_VERDICTS},
    base AS (
        SELECT row_id, coalesce(language, '') AS language, coalesce(a.n, '') AS rn, coalesce(b.n, '') AS hn
        FROM {_ATTEMPTS} JOIN {_RELEASE} USING (utterance_id) LEFT JOIN forms a ON a.t = transcription LEFT JOIN forms b ON b.t = prediction
    ),
    units AS (SELECT rn, hn, {_SPLIT('rn')} AS rw, {_SPLIT('hn')} AS hw, regexp_extract_all(rn, '(?s).') AS rc, regexp_extract_all(hn, '(?s).') AS hc FROM (SELECT DISTINCT rn, hn FROM base)),
    lexical AS (SELECT rn, hn, {_edits('rw', 'hw')} AS w_edits, len(rw) AS w_units, {_edits('rc', 'hc')} AS c_edits, len(rc) AS c_units FROM units),
    answers AS (
        SELECT row_id, response.equivalences AS es FROM (
            SELECT * FROM judge_cache WHERE row_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY response IS NOT NULL DESC, cached_at DESC NULLS LAST) = 1
        ) WHERE response IS NOT NULL
    ),
    proposed AS (SELECT row_id, unnest(es) AS e FROM answers),
    verified AS (
        SELECT p.row_id, v.kind, v.h, v.r, v.reason FROM proposed p JOIN verdicts v
        ON v.kind = lower(trim(coalesce(p.e.type, ''))) AND v.x = coalesce(p.e.hypothesis_span, '') AND v.y = coalesce(p.e.reference_span, '')
    ),
    tried AS (
        SELECT b.row_id, v.kind, v.h, {_SPLIT('b.rn')} AS rw, list_transform({_SPLIT('b.hn')}, lambda w: CASE WHEN w = v.h THEN v.r ELSE w END) AS tw, b.rn, b.hn
        FROM base b JOIN verified v USING (row_id) WHERE v.reason = 'ok' AND v.r IN (SELECT unnest({_SPLIT('b.rn')}))
    ),
    gained AS (SELECT row_id, kind, {_edits('rw', 'tw')} AS w, array_to_string(tw, ' ') AS text, rn, hn FROM tried),
    better AS (SELECT g.*, regexp_extract_all(rn, '(?s).') AS rc, regexp_extract_all(text, '(?s).') AS tc FROM gained g JOIN lexical USING (rn, hn) WHERE g.w < w_edits),
    applied AS (SELECT row_id, min(w) AS w, min({_edits('rc', 'tc')}) AS c, count(*) AS accepted, count(*) FILTER (WHERE kind = 'number') AS numbers FROM better GROUP BY row_id),
    asked AS (SELECT row_id, count(v.row_id) AS n FROM answers LEFT JOIN verified v USING (row_id) GROUP BY row_id),
    settled AS (
        SELECT b.row_id, b.language, l.w_edits, l.w_units, l.c_edits, l.c_units, CASE WHEN b.rn = '' THEN 'empty_reference' WHEN b.rn = b.hn THEN 'exact' WHEN b.hn = '' THEN 'empty_hypothesis' WHEN a.row_id IS NULL THEN 'judge_error'
            WHEN p.accepted > 0 THEN 'success' ELSE 'no_equivalences' END AS status, p.w, p.c, coalesce(p.accepted, 0) AS accepted, coalesce(p.numbers, 0) AS numbers, coalesce(a.n, 0) AS n
        FROM base b JOIN lexical l ON l.rn = b.rn AND l.hn = b.hn LEFT JOIN asked a ON a.row_id = b.row_id LEFT JOIN applied p ON p.row_id = b.row_id
    ),
    semantic AS (
        SELECT row_id AS row_key, language, w_edits AS word_edits, w_units AS words, c_edits AS char_edits, c_units AS chars, status,
            CASE WHEN status IN ('success', 'no_equivalences', 'exact', 'empty_hypothesis') THEN coalesce(CASE WHEN status = 'success' THEN w END, w_edits) END AS semantic_word_edits,
            CASE WHEN status IN ('success', 'no_equivalences', 'exact', 'empty_hypothesis') THEN coalesce(CASE WHEN status = 'success' THEN least(c, c_edits) END, c_edits) END AS semantic_char_edits,
            CASE WHEN status = 'success' THEN numbers ELSE 0 END AS number_pairs, CASE WHEN status = 'success' THEN accepted ELSE 0 END AS n_accepted,
            CASE WHEN status IN ('success', 'no_equivalences') THEN n - accepted ELSE 0 END AS n_rejected FROM settled
    )
"""

SQL: dict[str, str] = {
    "semantic_rows": f"""{_SEMANTIC} SELECT *, CASE WHEN words > 0 THEN CAST(semantic_word_edits AS DOUBLE) / words END AS semantic_wer,
        CASE WHEN chars > 0 THEN CAST(semantic_char_edits AS DOUBLE) / chars END AS semantic_cer FROM semantic""",
    "semantic_score": f"""{_SEMANTIC} SELECT language, count(*) AS utterances,
            CASE WHEN sum(words) FILTER (WHERE semantic_word_edits IS NOT NULL) > 0 THEN CAST(sum(semantic_word_edits) AS DOUBLE) / CAST(sum(words) FILTER (WHERE semantic_word_edits IS NOT NULL) AS DOUBLE) END AS semantic_wer,
            {_RATE('coalesce(semantic_word_edits, word_edits)', 'words')} AS semantic_wer_or_lexical, {_RATE('word_edits', 'words')} AS wer,
            avg(CAST(semantic_word_edits IS NOT NULL AS INTEGER)) AS coverage, CAST(sum(number_pairs) AS BIGINT) AS number_pairs
        FROM semantic GROUP BY language""",
    "pair_verdicts": f"WITH {_VERDICTS} SELECT kind, x AS hypothesis_span, y AS reference_span, reason = 'ok' AS accepted, reason FROM verdicts",
    "p4_found": f"""
        WITH cells AS (SELECT DISTINCT utterance_id, keywords, {_HIDDEN} AS h FROM release WHERE keywords IS NOT NULL AND lower({_BARE}) NOT IN ('', 'nan', 'none')),
        cut AS (SELECT utterance_id, list_transform(regexp_extract_all(h || ',', '{_ITEM}', 1), lambda x: trim(x)) AS l FROM cells),
        taken AS (SELECT utterance_id, list_filter(list_transform(l, lambda x: trim(replace(replace({_TAKEN}, chr(1), ','), chr(2), '/'))), lambda x: x <> '') AS l FROM cut)
        SELECT DISTINCT utterance_id, pos, l[pos] AS keyword FROM (SELECT utterance_id, l, unnest(range(1, len(l) + 1)) AS pos FROM taken)
    """,
    "p7_found": f"""
        SELECT DISTINCT line_id FROM raw_predictions
        WHERE raw_line IS NULL OR NOT regexp_full_match(raw_line, '{_SOUND}')
    """,
    "p7_reasons": f"""
        SELECT line_id, CASE
            WHEN raw_line IS NULL THEN 'no_record'
            WHEN length(replace(raw_line, '"', '')) % 2 <> length(raw_line) % 2 THEN 'unclosed_quote'
            WHEN NOT regexp_full_match(raw_line, '{_QUOTED}') THEN 'text_outside_quotes'
            WHEN regexp_matches(regexp_replace(raw_line, '"([^"]|"")*"', '', 'g'), '[\\r\\n]') THEN 'line_break_outside_quotes'
            WHEN len(f) <> 5 THEN 'wrong_column_count'
            WHEN NOT regexp_full_match(f[1], 'c[0-9]+_t[0-9]+') THEN 'bad_utterance_id'
            WHEN NOT regexp_full_match(f[3], '([0-9]+([.][0-9]+)?)?') THEN 'bad_latency_ms'
            WHEN lower(f[4]) NOT IN ({_LIST(STATUSES)}) THEN 'bad_status' END AS reason
        FROM {_RECORDS} WHERE reason IS NOT NULL
    """,
    "p7_rows": f"""
        SELECT line_id, f[1] AS utterance_id, f[2] AS prediction, TRY_CAST(nullif(f[3], '') AS DOUBLE) AS latency_ms, lower(f[4]) AS status, f[5] AS error
        FROM {_RECORDS} WHERE regexp_full_match(raw_line, '{_SOUND}')
    """,
    "scan_project": f"SELECT utterance_id, call_id, transcription, keywords FROM {_RELEASE}",
    "dedupe_last_success": f"SELECT provider, utterance_id, row_id FROM {_BEST}",
    "repeated_ids": f"SELECT utterance_id, count(*) AS n_rows FROM {_ATTEMPTS} GROUP BY utterance_id HAVING count(*) > 1",
    "missing_predictions": f"SELECT utterance_id FROM {_RELEASE} r WHERE NOT EXISTS (SELECT 1 FROM {_ATTEMPTS} a WHERE a.utterance_id = r.utterance_id)",
    "align_left": f"""
        SELECT r.utterance_id, transcription, coalesce(b.prediction, '') AS prediction
        FROM {_RELEASE} r LEFT JOIN (SELECT * FROM {_BEST} WHERE provider = 'aldervox') b USING (utterance_id)
    """,
    "tag_codes": f"SELECT utterance_id, array_to_string({_CODES}, ',') AS codes FROM {_RELEASE}",
    "without_languages": f"""
        SELECT utterance_id FROM (
            SELECT utterance_id, list_sort(list_distinct(CASE WHEN {_CODE} = '' THEN {_CODES} ELSE list_append({_CODES}, {_CODE}) END)) AS codes FROM {_RELEASE}
        ) WHERE NOT list_contains(codes, 'ml') AND codes <> ['hi', 'mr']
    """,
    "first_rows": f"SELECT utterance_id, coalesce(duration_sec, -1.0) AS seconds FROM {_RELEASE} ORDER BY seconds DESC, utterance_id LIMIT 100",
    "batch_sizes": f"""
        SELECT lane, batch, count(*) AS n FROM (
            SELECT concat_ws('/', language, domain) AS lane,
                CAST((row_number() OVER (PARTITION BY concat_ws('/', language, domain) ORDER BY utterance_id) - 1) // 16 AS BIGINT) AS batch
            FROM {_RELEASE}
        ) GROUP BY lane, batch
    """,
    "folded_texts": f"SELECT utterance_id, {_folded('transcription')} AS folded FROM {_RELEASE}",
    "settled_spellings": f"""
        SELECT row_id, coalesce(array_to_string(list_transform({_words('prediction')}, lambda w: {_settled('w')}), ' '), '') AS settled FROM predictions
    """,
    "number_forms": f"""
        WITH {_forms("SELECT transcription AS t FROM release UNION ALL SELECT prediction FROM predictions")}
        SELECT 'release' AS source_table, utterance_id AS record_id, coalesce(c, '') AS form FROM release LEFT JOIN forms ON t = transcription
        UNION ALL SELECT 'predictions', CAST(row_id AS VARCHAR), coalesce(c, '') FROM predictions LEFT JOIN forms ON t = prediction
    """,
    "spoken_numbers": f"""
        SELECT l_orderkey, l_partkey, l_linenumber, array_to_string(list_filter([
            {_DIGITS('CAST(l_orderkey AS VARCHAR)')}, 'line', CAST(l_linenumber AS VARCHAR), 'part', {_DIGITS('CAST(l_partkey AS VARCHAR)')},
            'rupees', {_DIGITS('CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)')}, 'less 0', {_DIGITS("lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 2, '0')")}, 'percent',
            {_DIGITS('CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)')}, 'नग'], lambda x: true), ' ') AS form
        FROM lineitem
    """,
    "loaded_predictions": """
        SELECT utterance_id, coalesce(prediction, '') AS prediction FROM predictions
        QUALIFY row_number() OVER (PARTITION BY utterance_id ORDER BY coalesce(lower(status) IN ('success', 'ok'), false) DESC, row_id DESC) = 1
    """,
    "row_counts": f"{_SCORED} SELECT provider, utterance_id, {', '.join(COUNTS)} FROM counted",
    "score_overall": f"""{_SCORED}, aligned AS (
            SELECT utterance_id, coalesce(b.prediction, '') AS prediction, transcription, keywords FROM {_RELEASE} LEFT JOIN (SELECT * FROM {_BEST} WHERE provider = 'aldervox') b USING (utterance_id)
        ), empty AS (
            SELECT a.utterance_id, len({_SPLIT('coalesce(f.n, \'\')')}) AS w_units, length(coalesce(f.n, '')) AS c_units, len({_MIXED('coalesce(f.n, \'\')')}) AS m_units,
                (SELECT count(DISTINCT m.n) FROM (SELECT n, unnest([n, s]) AS k FROM named d WHERE d.keywords = a.keywords) m WHERE {_says("coalesce(f.n, '')")} OR {_says("coalesce(f.s, '')")}) AS kw_total
            FROM aligned a LEFT JOIN forms f ON f.t = a.transcription WHERE a.utterance_id NOT IN (SELECT utterance_id FROM counted WHERE provider = 'aldervox')
        ), whole AS (
            SELECT {', '.join(COUNTS)} FROM counted WHERE provider = 'aldervox'
            UNION ALL SELECT w_units, w_units, c_units, c_units, m_units, m_units, 0, kw_total, 1 FROM empty
        ) SELECT {_FIGURES} FROM whole""",
    "score_by_provider": f"{_SCORED} SELECT provider, {_FIGURES} FROM counted WHERE provider IS NOT NULL GROUP BY provider",
    "score_sets": f"""{_SCORED}
        SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(domain) = 0 THEN 'domain' END AS breakdown,
            CASE WHEN grouping(provider) = 0 THEN provider WHEN grouping(language) = 0 THEN language WHEN grouping(domain) = 0 THEN domain END AS value, {_FIGURES}
        FROM counted GROUP BY GROUPING SETS ((), (provider), (language), (domain)) HAVING breakdown IS NULL OR value IS NOT NULL
    """,
    "call_totals": f"{_SCORED} SELECT call_id, {_SUMS} FROM counted WHERE call_id IS NOT NULL GROUP BY call_id",
    "mixed_unit_counts": f"{_SCORED} SELECT provider, utterance_id, m_edits AS edits, m_units AS units FROM counted",
    "keyword_misses": f"""{_SCORED} SELECT provider, utterance_id, kw_hits AS hits, kw_total AS scored,
            CASE WHEN kw_total > 0 THEN 1 - CAST(kw_hits AS DOUBLE) / CAST(kw_total AS DOUBLE) END AS rate FROM counted""",
    "normal_form_drift": f"""
        WITH {_forms("SELECT transcription AS t FROM release")}
        SELECT utterance_id, coalesce(n, '') AS expected FROM {_RELEASE} LEFT JOIN forms ON t = transcription
        WHERE transcription_normalized IS NOT NULL AND transcription_normalized <> coalesce(n, '')
    """,
    "weighted_ci": f"""{_SCORED}, totals AS (
            SELECT {_CALL_HASH} AS h, CAST(sum(w_edits) AS BIGINT) AS e, CAST(sum(w_units) AS BIGINT) AS u FROM counted WHERE provider = 'brooktalk' AND call_id IS NOT NULL GROUP BY call_id
        ), {_WEIGHED},
        rates AS (SELECT CAST(sum(e * w) AS DOUBLE) / CAST(sum(u * w) AS DOUBLE) AS v FROM weighed GROUP BY boot HAVING sum(u * w) > 0)
        SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM rates
    """,
    "paired_delta_ci": f"""{_SCORED}, released AS (
            SELECT call_id, CAST(sum(len({_SPLIT("coalesce(n, '')")})) AS BIGINT) AS u FROM {_RELEASE} LEFT JOIN forms ON t = transcription WHERE call_id IS NOT NULL GROUP BY call_id
        ), answered AS (
            SELECT call_id, coalesce(sum(w_edits - w_units) FILTER (WHERE provider = 'aldervox'), 0) AS a, coalesce(sum(w_edits - w_units) FILTER (WHERE provider = 'brooktalk'), 0) AS b
            FROM counted WHERE call_id IS NOT NULL GROUP BY call_id
        ), totals AS (
            -- an utterance without an answer has as many edits as words
            SELECT {_CALL_HASH} AS h, u, CAST(u + coalesce(a, 0) AS BIGINT) AS ea, CAST(u + coalesce(b, 0) AS BIGINT) AS eb FROM released LEFT JOIN answered USING (call_id)
        ), {_WEIGHED},
        deltas AS (SELECT CAST(sum(eb * w) AS DOUBLE) / CAST(sum(u * w) AS DOUBLE) - CAST(sum(ea * w) AS DOUBLE) / CAST(sum(u * w) AS DOUBLE) AS v FROM weighed GROUP BY boot HAVING sum(u * w) > 0)
        SELECT round((SELECT CAST(sum(eb) AS DOUBLE) / CAST(sum(u) AS DOUBLE) - CAST(sum(ea) AS DOUBLE) / CAST(sum(u) AS DOUBLE) FROM totals), 9) AS delta,
            round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM deltas
    """,
    "plain_word_counts": f"SELECT provider, utterance_id, edits, units FROM {_COUNTED}",
    "plain_wer_sets": f"""
        SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(domain) = 0 THEN 'domain' END AS breakdown,
            CASE WHEN grouping(provider) = 0 THEN provider WHEN grouping(language) = 0 THEN language WHEN grouping(domain) = 0 THEN domain END AS value,
            count(*) AS utterances, CAST(sum(units) AS BIGINT) AS reference_words,
            CASE WHEN sum(units) > 0 THEN CAST(sum(edits) AS DOUBLE) / CAST(sum(units) AS DOUBLE) END AS wer
        FROM {_COUNTED} GROUP BY GROUPING SETS ((), (provider), (language), (domain))
        HAVING breakdown IS NULL OR value IS NOT NULL
    """,
    "corpus_facts": f"""
        SELECT count(*) AS utterances, round(sum(duration_sec) / 3600, 6) AS hours, count(DISTINCT call_id) AS calls,
            round(avg(CAST(is_code_mixed AS INTEGER)), 9) AS mixed_share, round(avg(CAST(duration_sec < 2 AS INTEGER)), 9) AS short_share,
            round(avg(CAST(keywords IS NOT NULL AND lower(regexp_replace(keywords, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'nan', 'none') AS INTEGER)), 9) AS keyword_share
        FROM {_RELEASE}
    """,
    "sampled_in": "SELECT row_id FROM predictions WHERE CAST(('0x' || substr(sha1(CAST(row_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295 < 0.1",
    "question_keys": "SELECT row_id, sha1(coalesce(utterance_id, '') || chr(31) || coalesce(prediction, '') || chr(31) || coalesce(provider, '')) AS cache_key FROM predictions",
    "latest_answers": """
        SELECT cache_key, CAST(coalesce(len(response.equivalences), -1) AS BIGINT) AS n_pairs FROM judge_cache WHERE cache_key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY response IS NOT NULL DESC, cached_at DESC NULLS LAST) = 1
    """,
    "pending_rows": "SELECT row_id FROM predictions WHERE row_id NOT IN (SELECT row_id FROM judge_cache WHERE response IS NOT NULL AND row_id IS NOT NULL)",
    "routes": f"""
        SELECT utterance_id,
            CASE WHEN {_CODE} IN ('hi', 'en', 'bn', 'ta', 'te', 'kn', 'mr', 'gu') AND NOT (coalesce(is_code_mixed, false) AND {_CODE} IN ('hi', 'en')) THEN {_CODE} ELSE 'multi' END AS one_or_many,
            CASE WHEN {_CODE} IN ('hi', 'bn', 'ta', 'te', 'kn', 'ml', 'mr', 'gu', 'pa', 'od', 'en') THEN {_CODE} || '-IN' ELSE 'unknown' END AS regional,
            CASE WHEN {_CODE} IN ('', 'other', 'unknown') THEN '-' ELSE {_CODE} END AS code,
            CASE WHEN lower(trim(coalesce(language_tag, ''))) IN ('bn', 'en', 'gu', 'hi', 'kn', 'ml', 'mr', 'ta', 'te') THEN lower(trim(language_tag)) ELSE 'multi' END AS supported,
            coalesce(nullif(array_to_string(list_filter(hints, lambda c, i: list_position(hints, c) = i), ','), ''), '-') AS hints,
            CASE {_CODE} WHEN 'hi' THEN 'Hindi' WHEN 'bn' THEN 'Bengali' WHEN 'ta' THEN 'Tamil' WHEN 'te' THEN 'Telugu' WHEN 'kn' THEN 'Kannada' WHEN 'ml' THEN 'Malayalam'
                WHEN 'mr' THEN 'Marathi' WHEN 'gu' THEN 'Gujarati' WHEN 'pa' THEN 'Punjabi' WHEN 'od' THEN 'Odia' WHEN 'or' THEN 'Odia' WHEN 'as' THEN 'Assamese' WHEN 'en' THEN 'English' ELSE '' END AS name
        FROM (SELECT *, list_filter(list_append(string_split(translate(lower(trim(coalesce(language_tag, ''))), '_', '-'), '-'), {_CODE}),
            lambda c: c IN ('bn', 'en', 'gu', 'hi', 'kn', 'ml', 'mr', 'ta', 'te')) AS hints FROM {_RELEASE})
    """,
    "status_counts": "SELECT coalesce(lower(trim(status)), '') AS status, count(*) AS n FROM predictions GROUP BY 1",
    "run_tallies": f"""
        SELECT count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed
        FROM (SELECT utterance_id, bool_or(coalesce(lower(status) = 'success', false)) AS ok FROM {_ATTEMPTS} WHERE utterance_id <> '' GROUP BY utterance_id)
    """,
    "unfinished": f"SELECT utterance_id FROM {_RELEASE} WHERE utterance_id NOT IN (SELECT utterance_id FROM {_ATTEMPTS} WHERE lower(status) = 'success' AND utterance_id IS NOT NULL)",
    "transcribed": f"""
        SELECT utterance_id, CASE WHEN transcription IS NULL THEN '' ELSE coalesce(nullif(language, ''), 'und') || ' ' || substr(sha1(transcription), 1, 8) END AS prediction,
            CASE WHEN transcription IS NULL THEN 'missing_audio' ELSE 'success' END AS status
        FROM {_RELEASE}
    """,
    "streamed_scores": f"""{_scored(f'(SELECT * FROM {_ATTEMPTS} WHERE good)')}
        SELECT provider, language, {_SUMS}, CAST(count(*) AS BIGINT) AS utterances FROM counted GROUP BY provider, language
    """,
    "streamed_status_days": """
        SELECT strftime(written_at, '%Y-%m-%d') AS day, lower(trim(coalesce(status, ''))) AS status, count(*) AS n
        FROM predictions WHERE written_at IS NOT NULL GROUP BY 1, 2
    """,
}
