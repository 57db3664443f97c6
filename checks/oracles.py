"""DuckDB SQL for every query, written from the rules and not from the Spark code.

Each text is a list of common table expressions and a final SELECT. The rules are
stated the long way: all candidate pairs are formed, segments are compared place
by place, and the similarity ratio is a recursive query over matching blocks.
"""

from __future__ import annotations

from checks.adapter import FUNDER, GRANTS_RAW, INPUT_RAW, LISTED_RAW

CTES: dict[str, str] = {
    "grants_raw": GRANTS_RAW,
    "grants": """
        SELECT work_id, lower(trim(doi)) AS doi, field_name, subfield_path,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.funder') END AS funder,
               CASE WHEN json_valid(value) THEN json_extract_string(value, '$.award_id') END AS award_id,
               source_id, doi_prefix, source_file_path
        FROM grants_raw""",
    "mine": f"SELECT DISTINCT work_id, doi, award_id FROM grants WHERE funder = '{FUNDER}'",
    "input_raw": INPUT_RAW,
    "listed_raw": LISTED_RAW,
    "input": """
        SELECT CASE WHEN d IN ('', 'nan') THEN NULL ELSE d END AS doi, award_id, programme
        FROM (SELECT lower(trim(doi)) AS d, award_id, programme FROM input_raw)""",
    # Joined rows of the funder, and distinct pairs of ids on one DOI.
    "joined": """
        SELECT DISTINCT i.doi, i.award_id, i.programme, g.award_id AS corpus_award_id, g.work_id
        FROM input i JOIN mine g ON i.doi = g.doi
        WHERE i.award_id IS NOT NULL AND g.award_id IS NOT NULL""",
    "all_pairs": """
        SELECT DISTINCT i.award_id AS id1, g.award_id AS id2 FROM input i JOIN grants g ON i.doi = g.doi
        WHERE i.award_id IS NOT NULL AND g.award_id IS NOT NULL""",
    "joined_pairs": "SELECT DISTINCT award_id AS id1, corpus_award_id AS id2 FROM joined",
    "awards": """
        SELECT award_id FROM input WHERE award_id IS NOT NULL
        UNION SELECT award_id FROM grants WHERE award_id IS NOT NULL""",
}


def _norm(text: str) -> str:
    return f"upper(regexp_replace({text}, '[^A-Za-z0-9]', '', 'g'))"


def _segs(text: str) -> str:
    return f"list_filter(string_split_regex(upper({text}), '[-_./\\s]+'), lambda s: s <> '')"


def _digits(text: str) -> str:
    return f"regexp_full_match({text}, '[0-9]+')"


def _numeric(segs: str) -> str:
    return f"len(list_filter({segs}, lambda s: {_digits('s')}))"


def _compatible(x: str, y: str) -> str:
    runs_x, runs_y = (f"list_transform(regexp_extract_all({s}, '[0-9]+'), lambda r: ltrim(r, '0'))" for s in (x, y))
    shared = f"least(len({runs_x}), len({runs_y}))"
    letters_x, letters_y = (f"regexp_replace({s}, '[0-9]', '', 'g')" for s in (x, y))
    return f"""CASE
        WHEN {x} = {y} THEN true
        WHEN {_digits(x)} AND {_digits(y)} THEN ltrim({x}, '0') = ltrim({y}, '0')
          OR (length({x}) = 4 AND length({y}) = 2 AND ends_with({x}, {y}))
          OR (length({y}) = 4 AND length({x}) = 2 AND ends_with({y}, {x}))
        WHEN {_digits(x)} OR {_digits(y)} THEN false
        WHEN (starts_with({x}, {y}) OR starts_with({y}, {x})) AND {shared} > 0
          AND ({runs_x})[1:{shared}] = ({runs_y})[1:{shared}] THEN true
        WHEN {letters_x} = {letters_y} THEN {shared} = 0 OR ({runs_x})[1] = ({runs_y})[1]
        ELSE contains({x}, {y}) OR contains({y}, {x}) END"""


def _featured(pairs: str) -> dict[str, str]:
    """Features of the ids of a pair relation, structured match and confidence."""
    return {
        "featured": f"""
            SELECT id1, id2, trim(id1) AS t1, trim(id2) AS t2, {_norm('id1')} AS n1, {_norm('id2')} AS n2,
                   {_segs('id1')} AS s1, {_segs('id2')} AS s2, {_numeric(_segs('id1'))} AS c1,
                   {_numeric(_segs('id2'))} AS c2
            FROM {pairs}""",
        "places": """
            SELECT id1, id2, len(s1) AS len1, len(s2) AS len2, s1, s2,
                   unnest(range(1, least(len(s1), len(s2)) + 1)) AS i
            FROM featured WHERE abs(len(s1) - len(s2)) <= 2""",
        "meetings": "SELECT DISTINCT s1[i] AS x, s2[i] AS y FROM places",
        "verdicts": f"SELECT x, y, {_compatible('x', 'y')} AS ok, {_digits('x')} AND {_digits('y')} AS numbers FROM meetings",
        "judged": """
            SELECT id1, id2, len1, len2, i, ok,
                   NOT ok AND numbers AND (i = 1 OR i = len1 OR i = len2) AS stops
            FROM places JOIN verdicts ON s1[i] = x AND s2[i] = y""",
        "stops": "SELECT id1, id2, min(i) AS stop FROM judged WHERE stops GROUP BY id1, id2",
        "counted": """
            SELECT id1, id2, any_value(stop) AS stop,
                   count(*) FILTER (WHERE ok AND (stop IS NULL OR i < stop)) / greatest(any_value(len1), any_value(len2)) AS confidence
            FROM judged LEFT JOIN stops USING (id1, id2) GROUP BY id1, id2""",
        "structured": """
            SELECT f.*, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence,
                   coalesce(stop IS NULL AND confidence >= 0.75, false) AS structured
            FROM featured f LEFT JOIN counted USING (id1, id2)""",
    }


# Longest matching block, then the same left and right of it, until nothing matches.
# Ties go to the earliest place in the first text, then in the second.
RATIO = {
    "texts": "SELECT DISTINCT n1 AS a, n2 AS b FROM featured",
    "blocks": """
        SELECT a, b, 0 AS step, 1 AS alo, length(a) AS ahi, 1 AS blo, length(b) AS bhi, 0 AS k FROM texts
        UNION ALL
        SELECT a, b, step + 1, (u).alo, (u).ahi, (u).blo, (u).bhi, (u).k FROM (
          SELECT a, b, step, unnest([
              struct_pack(alo := alo, ahi := (best).i - 1, blo := blo, bhi := (best).j - 1, k := (best).n),
              struct_pack(alo := (best).i + (best).n, ahi := ahi, blo := (best).j + (best).n, bhi := bhi, k := 0)]) AS u
          FROM (
            SELECT a, b, step, alo, ahi, blo, bhi, min(struct_pack(neg := -n, i := i, j := j, n := n)) AS best FROM (
              SELECT a, b, step, alo, ahi, blo, bhi, min(i) AS i, min(j) AS j, count(*) AS n FROM (
                SELECT *, i - row_number() OVER (PARTITION BY a, b, alo, ahi, blo, bhi, i - j ORDER BY i) AS island
                FROM (SELECT *, unnest(range(blo, bhi + 1)) AS j
                      FROM (SELECT *, unnest(range(alo, ahi + 1)) AS i FROM blocks WHERE alo <= ahi AND blo <= bhi))
                WHERE a[i] = b[j])
              GROUP BY a, b, step, alo, ahi, blo, bhi, i - j, island)
            GROUP BY a, b, step, alo, ahi, blo, bhi))""",
    "ratios": """
        SELECT a, b, CAST(max(k) FILTER (WHERE step = 1) AS BIGINT) AS longest,
               CASE WHEN a = '' OR b = '' THEN 0.0
                    ELSE 2.0 * CAST(sum(k) AS DOUBLE) / (length(a) + length(b)) END AS ratio
        FROM blocks GROUP BY a, b""",
}

BLANK = "(t1 = '' OR t2 = '')"
CONTAINED = "(contains(n1, n2) OR contains(n2, n1))"
SUBSTRING = f"(NOT {BLANK} AND (contains(t1, t2) OR contains(t2, t1) OR {CONTAINED}))"


def _fuzzy(last: str) -> str:
    return f"""(CASE WHEN {BLANK} THEN false WHEN {CONTAINED} OR structured THEN true
        WHEN confidence < 0.5 THEN false WHEN c1 >= 2 AND c2 >= 2 THEN false
        WHEN least(length(n1), length(n2)) <= 3 THEN false ELSE {last} END)"""


BY_RATIO = """(CASE WHEN regexp_matches(n1, '[0-9]') AND regexp_matches(n2, '[0-9]')
    THEN ratio >= CAST(0.95 AS DOUBLE) ELSE ratio >= CAST(0.90 AS DOUBLE) END)"""
STRICT_TYPE = f"CASE WHEN t1 = t2 THEN 'exact' WHEN {SUBSTRING} THEN 'substring' END"
STRUCTURED_TYPE = f"CASE WHEN t1 = t2 THEN 'exact' WHEN {SUBSTRING} THEN 'substring' WHEN {_fuzzy('false')} THEN 'fuzzy' END"
FULL_TYPE = f"CASE WHEN t1 = t2 THEN 'exact' WHEN {SUBSTRING} THEN 'substring' WHEN {_fuzzy(BY_RATIO)} THEN 'fuzzy' END"

BEST_MEASURE = f"""greatest(
    CASE WHEN {CONTAINED} THEN greatest(CAST(0.9 AS DOUBLE), least(length(n1), length(n2)) / greatest(length(n1), length(n2))) ELSE 0 END,
    ratio,
    CASE WHEN n1 <> '' AND n2 <> '' THEN 1.0 - CAST(levenshtein(n1, n2) AS DOUBLE) / greatest(length(n1), length(n2)) ELSE 0 END,
    CASE WHEN n1 <> '' AND n2 <> '' THEN coalesce(longest, 0) / ((length(n1) + length(n2)) / 2) ELSE 0 END)"""
SCORE = f"""CAST(round(CASE WHEN t1 = t2 THEN 1.0 WHEN n1 = n2 THEN 0.95 WHEN c1 >= 2 AND c2 >= 2 THEN confidence
    WHEN confidence > 0 THEN least({BEST_MEASURE}, confidence + CAST(0.1 AS DOUBLE)) ELSE {BEST_MEASURE} END, 3) AS DOUBLE)"""


def _scored(pairs: str, kind: str, with_ratio: bool = True, with_score: bool = True) -> dict[str, str]:
    """``scored``: (id1, id2, match_type, similarity_score) of a pair relation."""
    ctes = dict(_featured(pairs))
    source, score = "structured", ""
    if with_ratio:
        ctes |= RATIO
        source = "structured JOIN ratios ON n1 = a AND n2 = b"
        score = f", {SCORE} AS similarity_score" if with_score else ""
    return ctes | {"scored": f"SELECT id1, id2, {kind} AS match_type{score} FROM {source}"}


# Overlap: every pair of ids that share an indexed segment is formed and tested.
OVERLAP = {
    "unmatched": """
        SELECT * FROM mine g WHERE NOT EXISTS (SELECT 1 FROM input i WHERE i.doi = g.doi)""",
    "corpus_index": f"""
        SELECT DISTINCT award_id, unnest({_segs('award_id')}) AS segment
        FROM (SELECT DISTINCT award_id FROM unmatched WHERE award_id IS NOT NULL)""",
    "input_index": f"""
        SELECT award_id, segment FROM (
          SELECT DISTINCT award_id, unnest({_segs('award_id')}) AS segment
          FROM (SELECT DISTINCT award_id FROM input WHERE award_id IS NOT NULL))
        WHERE length(segment) > 2 OR NOT {_digits('segment')}""",
    "candidates": """
        SELECT DISTINCT c.award_id AS id1, i.award_id AS id2
        FROM corpus_index c JOIN input_index i USING (segment)""",
    "contained_pairs": f"""
        SELECT *, abs(length(n1) - length(n2)) AS gap FROM (
          SELECT id1, id2, trim(id1) AS t1, trim(id2) AS t2, {_norm('id1')} AS n1, {_norm('id2')} AS n2 FROM candidates)
        WHERE t1 = t2 OR {SUBSTRING}""",
    "best": """
        SELECT id1, id2, t1 = t2 AS exact, gap FROM contained_pairs
        QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY t1 <> t2, gap, id2) = 1""",
}
CORPUS_ONLY = {
    "corpus_only": """
        SELECT work_id, doi, award_id, id2 AS matching_input_award_id, id2 IS NOT NULL AS has_award_overlap,
               CASE WHEN award_id IS NULL THEN true END AS has_no_award_id,
               CASE WHEN exact THEN 'exact' WHEN id2 IS NOT NULL THEN 'substring' END AS match_type
        FROM unmatched LEFT JOIN best ON award_id = id1""",
}
BEST_SCORED = _scored("best", "CASE WHEN t1 = t2 THEN 'exact' ELSE 'substring' END")

ABSENT = {
    "absent": """
        SELECT DISTINCT i.doi, i.award_id, i.programme, w.work_id
        FROM input i LEFT JOIN (SELECT doi, min(work_id) AS work_id FROM grants GROUP BY doi) w ON w.doi = i.doi
        WHERE i.doi IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mine g WHERE g.doi = i.doi)""",
}
STRICT = _scored("joined_pairs", STRICT_TYPE, with_ratio=False)
COMPARED = {
    "compared": """
        SELECT joined.*, award_id AS funder_award_id, scored.* EXCLUDE (id1, id2)
        FROM joined JOIN scored ON award_id = id1 AND corpus_award_id = id2""",
}
CONSOLIDATED = {
    "consolidated": """
        SELECT doi, CASE WHEN match_type IS NULL THEN award_id END AS award_id, programme, corpus_award_id, work_id,
               coalesce(match_type, 'no_match') AS match_type, funder_award_id,
               CASE WHEN match_type IS NULL THEN 'award_differs' ELSE 'matched' END AS category,
               CAST(NULL AS VARCHAR) AS matching_input_award_id, CAST(NULL AS BOOLEAN) AS has_award_overlap,
               CAST(NULL AS BOOLEAN) AS has_no_award_id, similarity_score
        FROM compared
        UNION ALL
        SELECT doi, award_id, programme, NULL, work_id, NULL, NULL, 'absent_from_corpus', NULL, NULL, NULL, NULL FROM absent
        UNION ALL
        SELECT doi, award_id, NULL, NULL, work_id, match_type, NULL, 'corpus_only', matching_input_award_id,
               has_award_overlap, has_no_award_id, similarity_score
        FROM corpus_only LEFT JOIN (SELECT id1, id2, similarity_score FROM scored)
        ON award_id = id1 AND matching_input_award_id = id2""",
}
# Pairs of either result, scored together; the id of the corpus comes first among overlaps.
REPORT_PAIRS = {"report_pairs": "SELECT id1, id2 FROM joined_pairs UNION SELECT id1, id2 FROM best"}
ALL_RESULTS = (OVERLAP | REPORT_PAIRS | _scored("report_pairs", FULL_TYPE) | COMPARED | CORPUS_ONLY | ABSENT
               | CONSOLIDATED)

PROFILE = "count(DISTINCT doi) AS unique_dois, count(DISTINCT award_id) AS unique_awards, count(*) AS total_records"

# The same for all funders: rows meet within their funder.
ALL = {
    "input": """
        SELECT CASE WHEN d IN ('', 'nan') THEN NULL ELSE d END AS doi, award_id, programme, funder, list_no AS "list no."
        FROM (SELECT *, lower(trim(doi)) AS d FROM listed_raw)""",
    "mine": "SELECT DISTINCT funder, work_id, doi, award_id FROM grants WHERE funder IS NOT NULL",
    "joined": """
        SELECT DISTINCT i.doi, i.award_id, i.programme, i.funder, i."list no.", g.award_id AS corpus_award_id, g.work_id
        FROM input i JOIN mine g ON i.doi = g.doi AND i.funder = g.funder
        WHERE i.award_id IS NOT NULL AND g.award_id IS NOT NULL""",
    "absent": """
        SELECT DISTINCT i.*, w.work_id
        FROM input i LEFT JOIN (SELECT doi, min(work_id) AS work_id FROM grants GROUP BY doi) w ON w.doi = i.doi
        WHERE i.doi IS NOT NULL AND i.funder IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM mine g WHERE g.doi = i.doi AND g.funder = i.funder)""",
    "unmatched": """
        SELECT * FROM mine g WHERE NOT EXISTS (SELECT 1 FROM input i WHERE i.doi = g.doi AND i.funder = g.funder)""",
    "corpus_index": f"""
        SELECT DISTINCT funder, award_id, unnest({_segs('award_id')}) AS segment
        FROM (SELECT DISTINCT funder, award_id FROM unmatched WHERE award_id IS NOT NULL)""",
    "input_index": f"""
        SELECT funder, award_id, segment FROM (
          SELECT DISTINCT funder, award_id, unnest({_segs('award_id')}) AS segment
          FROM (SELECT DISTINCT funder, award_id FROM input WHERE award_id IS NOT NULL AND funder IS NOT NULL))
        WHERE length(segment) > 2 OR NOT {_digits('segment')}""",
    "candidates": """
        SELECT DISTINCT c.funder, c.award_id AS id1, i.award_id AS id2
        FROM corpus_index c JOIN input_index i USING (funder, segment)""",
    "contained_pairs": f"""
        SELECT *, abs(length(n1) - length(n2)) AS gap FROM (
          SELECT funder, id1, id2, trim(id1) AS t1, trim(id2) AS t2, {_norm('id1')} AS n1, {_norm('id2')} AS n2 FROM candidates)
        WHERE t1 = t2 OR {SUBSTRING}""",
    "best": """
        SELECT funder, id1, id2, t1 = t2 AS exact, gap FROM contained_pairs
        QUALIFY row_number() OVER (PARTITION BY funder, id1 ORDER BY t1 <> t2, gap, id2) = 1""",
    "corpus_only": """
        SELECT u.funder, work_id, doi, award_id, id2 AS matching_input_award_id, id2 IS NOT NULL AS has_award_overlap,
               CASE WHEN award_id IS NULL THEN true END AS has_no_award_id,
               CASE WHEN exact THEN 'exact' WHEN id2 IS NOT NULL THEN 'substring' END AS match_type
        FROM unmatched u LEFT JOIN best b ON award_id = id1 AND u.funder = b.funder""",
    "consolidated": """
        SELECT funder, coalesce(match_type, 'no_match') AS match_type, CAST(NULL AS BOOLEAN) AS has_award_overlap,
               CASE WHEN match_type IS NULL THEN 'award_differs' ELSE 'matched' END AS category FROM compared
        UNION ALL SELECT funder, NULL, NULL, 'absent_from_corpus' FROM absent
        UNION ALL SELECT funder, match_type, has_award_overlap, 'corpus_only' FROM corpus_only""",
}


def _types(condition: str, prefix: str, suffix: str) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {condition} AND match_type = '{k}') AS {prefix}{k}{suffix}"
        for k in ("exact", "substring", "normalized", "fuzzy")
    )


SUMMARY = {
    "numbers": f"""
        SELECT * FROM
          (SELECT count(*) AS total_records, count(doi) AS records_with_doi, count(*) - count(doi) AS records_without_doi,
                  count(DISTINCT doi) AS unique_dois, count(DISTINCT award_id) AS unique_award_ids FROM input),
          (SELECT count(DISTINCT doi) AS funder_unique_dois, count(DISTINCT award_id) AS funder_unique_awards,
                  count(*) AS funder_total_mappings FROM grants WHERE funder = '{FUNDER}'),
          (SELECT count(*) FILTER (WHERE category = 'matched') AS matched,
                  count(*) FILTER (WHERE category = 'award_differs') AS award_differs,
                  count(*) FILTER (WHERE category = 'absent_from_corpus') AS absent_from_corpus,
                  count(*) FILTER (WHERE category = 'corpus_only') AS corpus_only,
                  {_types("category = 'matched'", "", "_matches")},
                  count(*) FILTER (WHERE category = 'corpus_only') AS total_not_matched_by_doi,
                  count(*) FILTER (WHERE has_award_overlap) AS with_award_overlap,
                  count(*) FILTER (WHERE category = 'corpus_only' AND NOT has_award_overlap) AS truly_missing,
                  {_types("has_award_overlap", "overlap_", "")}
           FROM consolidated)""",
    "summary": """
        SELECT *, 100.0 * CAST(matched AS DOUBLE) / records_with_doi AS pct_work_and_award_matched,
               100.0 * CAST(award_differs AS DOUBLE) / records_with_doi AS pct_work_matched_award_differs,
               100.0 * CAST(absent_from_corpus AS DOUBLE) / records_with_doi AS pct_records_not_in_corpus
        FROM numbers""",
}

# The same by funder, for every one that the list or the corpus knows.
SUMMARY_ALL = {
    "numbers": f"""
        SELECT * FROM
          (SELECT funder, count(*) AS total_records, count(doi) AS records_with_doi, count(*) - count(doi) AS records_without_doi,
                  count(DISTINCT doi) AS unique_dois, count(DISTINCT award_id) AS unique_award_ids
           FROM input WHERE funder IS NOT NULL GROUP BY funder)
          FULL JOIN (SELECT funder, count(DISTINCT doi) AS funder_unique_dois, count(DISTINCT award_id) AS funder_unique_awards,
                  count(*) AS funder_total_mappings FROM grants WHERE funder IS NOT NULL GROUP BY funder) USING (funder)
          FULL JOIN (SELECT funder, count(*) FILTER (WHERE category = 'matched') AS matched,
                  count(*) FILTER (WHERE category = 'award_differs') AS award_differs,
                  count(*) FILTER (WHERE category = 'absent_from_corpus') AS absent_from_corpus,
                  count(*) FILTER (WHERE category = 'corpus_only') AS corpus_only,
                  {_types("category = 'matched'", "", "_matches")},
                  count(*) FILTER (WHERE category = 'corpus_only') AS total_not_matched_by_doi,
                  count(*) FILTER (WHERE has_award_overlap) AS with_award_overlap,
                  count(*) FILTER (WHERE category = 'corpus_only' AND NOT has_award_overlap) AS truly_missing,
                  {_types("has_award_overlap", "overlap_", "")}
           FROM consolidated GROUP BY funder) USING (funder)""",
    "summary": SUMMARY["summary"].replace("/ records_with_doi", "/ nullif(records_with_doi, 0)"),
}

# Section, title, condition, and its metrics with their labels.
SECTIONS = [
    ("input", "Input list", "true",
     {"total_records": "Total Records", "records_with_doi": "Records With Doi",
      "records_without_doi": "Records Without Doi", "unique_dois": "Unique Dois",
      "unique_award_ids": "Unique Award Ids"}),
    ("corpus", "Corpus, this funder", "true",
     {"funder_unique_dois": "Unique Dois", "funder_unique_awards": "Unique Awards",
      "funder_total_mappings": "Total Mappings"}),
    ("results", "Results", "true",
     {"matched": "Matched", "award_differs": "Award Differs", "absent_from_corpus": "Absent From Corpus",
      "corpus_only": "Corpus Only"}),
    ("match_types", "Match types", "matched > 0",
     {"exact_matches": "Exact Matches", "substring_matches": "Substring Matches",
      "normalized_matches": "Normalized Matches", "fuzzy_matches": "Fuzzy Matches"}),
    ("overlap", "Award ids of corpus rows whose DOI the input lacks", "corpus_only > 0",
     {"total_not_matched_by_doi": "Total Not Matched By Doi", "with_award_overlap": "With Award Overlap",
      "truly_missing": "Truly Missing"}),
    ("overlap_types", "Overlap by match type", "with_award_overlap > 0",
     {"overlap_exact": "Exact", "overlap_substring": "Substring", "overlap_normalized": "Normalized",
      "overlap_fuzzy": "Fuzzy"}),
    ("percentages", "Percentages of input rows with DOI", "records_with_doi > 0",
     {"pct_work_and_award_matched": "Work And Award Matched",
      "pct_work_matched_award_differs": "Work Matched Award Differs",
      "pct_records_not_in_corpus": "Records Not In Corpus"}),
]
NOTE = "'Overlap includes ' || format('{:,}', records_without_doi) || ' input rows without DOI'"
NOTE_SHOWN = "corpus_only > 0 AND records_without_doi > 0"


def _value(section: str, metric: str) -> str:
    return f"printf('%.2f%%', {metric})" if section == "percentages" else f"format('{{:,}}', {metric})"


def _statistics_all() -> str:
    return " UNION ALL ".join(
        f"SELECT funder, '{section}' AS section, '{metric}' AS metric, "
        + (f"{metric} AS value" if section == "percentages" else f"CAST(coalesce({metric}, 0) AS DOUBLE) AS value") + " FROM summary"
        for section, _, _, metrics in SECTIONS for metric in metrics
    )


def _statistics() -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({metric} AS DOUBLE) AS value FROM summary"
        for section, _, _, metrics in SECTIONS for metric in metrics
    )


def _numbered(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, {row} FROM summary WHERE {shown}" for i, (shown, row) in enumerate(rows)
    )


def _report_lines() -> str:
    rows = [("true", f"'{text}' AS line") for text in ("RECONCILIATION REPORT", "input: input", f"funder: {FUNDER}")]
    for section, title, shown, metrics in SECTIONS:
        rows.append((shown, f"'{title}:' AS line"))
        rows += [(shown, f"'  {m}: ' || {_value(section, m)} AS line") for m in metrics]
        if section == "overlap_types":
            rows.append((NOTE_SHOWN, f"'  ' || {NOTE} AS line"))
    return _numbered(rows)


def _sheet() -> str:
    rows = [("true", "'Input' AS metric, 'input' AS value"), ("true", f"'Funder' AS metric, '{FUNDER}' AS value")]
    for section, title, shown, metrics in SECTIONS:
        rows.append((shown, f"'{title.upper()}' AS metric, '' AS value"))
        rows += [(shown, f"'{label}' AS metric, {_value(section, m)} AS value") for m, label in metrics.items()]
        if section == "overlap_types":
            rows.append((NOTE_SHOWN, f"'Note' AS metric, {NOTE} AS value"))
    return _numbered(rows)


def _with(select: str, *extra: dict[str, str]) -> str:
    """A query over the common expressions it needs."""
    ctes = dict(CTES)
    for more in extra:
        ctes |= more
    needed, queue = set(), [select]
    while queue:
        text = queue.pop()
        for name in ctes.keys() - needed:
            if any(name == word for word in _words(text)):
                needed.add(name)
                queue.append(ctes[name])
    head = ",\n".join(f"{name} AS ({ctes[name]})" for name in ctes if name in needed)
    return f"WITH RECURSIVE {head}\n{select}" if "blocks" in needed else f"WITH {head}\n{select}"


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split()


RESULT = "doi, programme, funder_award_id, corpus_award_id, work_id"
FEATURED = _featured("all_pairs")

ORACLES: dict[str, str] = {
    "scan_grants_csv": _with("SELECT * FROM grants_raw"),
    "scan_input_csv": _with(
        "SELECT CASE WHEN doi NOT IN ('', 'nan') THEN doi END AS doi, award_id, programme FROM input_raw"),
    "build_grants": _with("SELECT * FROM grants"),
    "json_extract": _with(
        "SELECT work_id, funder, award_id FROM grants UNION ALL "
        "SELECT CAST(event_id AS VARCHAR), json_extract_string(props, '$.funder'), "
        "json_extract_string(props, '$.award_id') FROM events"),
    "clean_input_doi": _with(
        "SELECT DISTINCT doi AS raw_doi, CASE WHEN lower(trim(doi)) NOT IN ('', 'nan') THEN lower(trim(doi)) END AS doi "
        "FROM input_raw"),
    "split_by_doi": _with(
        "SELECT *, CASE WHEN doi IS NULL THEN 'without_doi' ELSE 'with_doi' END AS part FROM input"),
    "null_award_split": _with(
        "SELECT *, CASE WHEN award_id IS NULL THEN 'without_award' ELSE 'with_award' END AS part FROM mine"),
    "funder_grants": _with("SELECT * FROM mine"),
    "distinct_awards": _with("SELECT DISTINCT award_id FROM input WHERE award_id IS NOT NULL"),
    "build_metadata": _with(
        "SELECT 'total_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM grants UNION ALL "
        "SELECT 'parsed_rows', CAST(count(*) FILTER (WHERE funder IS NOT NULL) AS VARCHAR) FROM grants"),
    "input_renamed": _with("SELECT * FROM input"),
    "database_info": _with(
        "SELECT 'metadata' AS section, 'total_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM grants UNION ALL "
        "SELECT 'metadata', 'parsed_rows', CAST(count(funder) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'profile', 'total_records', CAST(count(*) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'profile', 'unique_dois', CAST(count(DISTINCT doi) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'profile', 'unique_funders', CAST(count(DISTINCT funder) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'profile', 'unique_awards', CAST(count(DISTINCT award_id) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'profile', 'parsed_rows', CAST(count(funder) AS VARCHAR) FROM grants UNION ALL "
        "SELECT 'funders', funder, CAST(n AS VARCHAR) FROM (SELECT funder, count(*) AS n FROM grants "
        "WHERE funder IS NOT NULL GROUP BY funder ORDER BY n DESC, funder LIMIT 10)"),
    "award_differs_missing": _with(
        "SELECT DISTINCT i.award_id, i.doi, i.programme, i.award_id AS funder_award_id, g.award_id AS corpus_award_id, "
        "g.work_id, 'missing' AS match_type, CASE WHEN i.award_id IS NULL AND g.award_id IS NULL THEN 1.0::DOUBLE "
        "ELSE 0.0::DOUBLE END AS similarity_score "
        "FROM input i JOIN mine g ON i.doi = g.doi WHERE i.award_id IS NULL OR g.award_id IS NULL"),
    "largest_products": _with(
        "SELECT doi, a.n * b.n AS pairs FROM (SELECT doi, count(*) AS n FROM (SELECT DISTINCT * FROM input) GROUP BY doi) a "
        "JOIN (SELECT doi, count(*) AS n FROM mine GROUP BY doi) b USING (doi) ORDER BY pairs DESC, doi LIMIT 10"),
    "quality_checks": _with(
        "SELECT 'grants_not_empty' AS check_name, count(*) > 0 AS passed, count(*) AS observed FROM grants UNION ALL "
        "SELECT 'some_funder_parsed', count(funder) > 0, count(funder) FROM grants UNION ALL "
        "SELECT 'value_is_json', count(*) = 0, count(*) FROM grants_raw "
        "WHERE value IS NOT NULL AND NOT json_valid(value) UNION ALL "
        "SELECT 'metadata_keys_unique', count(*) = count(DISTINCT key), count(*) - count(DISTINCT key) FROM ("
        "SELECT unnest(['source_file', 'total_rows', 'parsed_rows', 'build_date']) AS key)"),
    "table_profile": _with(
        "SELECT count(*) AS total_records, count(DISTINCT doi) AS unique_dois, count(DISTINCT funder) AS unique_funders, "
        "count(DISTINCT award_id) AS unique_awards, count(*) FILTER (WHERE funder IS NOT NULL) AS parsed_rows FROM grants"),
    "funder_profile": _with(f"SELECT {PROFILE} FROM grants WHERE funder = '{FUNDER}'"),
    "funder_profile_all": _with(f"SELECT funder, {PROFILE} FROM grants WHERE funder IS NOT NULL GROUP BY funder"),
    "top_funders": _with(
        "SELECT funder, count(*) AS n FROM grants WHERE funder IS NOT NULL GROUP BY funder ORDER BY n DESC, funder LIMIT 10"),
    "input_profile": _with(
        "SELECT count(*) AS total_records, count(doi) AS records_with_doi, count(*) FILTER (WHERE doi IS NULL) AS "
        "records_without_doi, count(DISTINCT doi) AS unique_dois, count(DISTINCT award_id) AS unique_award_ids FROM input"),
    "award_normalize": _with(f"SELECT award_id, {_norm('award_id')} AS norm FROM awards"),
    "award_segments": _with(
        f"SELECT award_id, array_to_string({_segs('award_id')}, '|') AS segments, "
        f"CAST({_numeric(_segs('award_id'))} AS BIGINT) AS n_numeric FROM awards"),
    "pair_exact": _with("SELECT id1, id2, t1 = t2 AS is_exact FROM featured", FEATURED),
    "pair_substring": _with(f"SELECT id1, id2, {SUBSTRING} AS is_substring FROM featured", FEATURED),
    "pair_normalized": _with(
        f"SELECT id1, id2, CASE WHEN t1 = t2 THEN 'exact' WHEN NOT {BLANK} AND n1 = n2 THEN 'normalized' END AS match_type "
        "FROM featured", FEATURED),
    "segment_compat": _with(
        f"SELECT segment1, segment2, {_compatible('segment1', 'segment2')} AS compatible FROM ("
        "SELECT DISTINCT s1[i] AS segment1, s2[i] AS segment2 FROM ("
        "SELECT s1, s2, unnest(range(1, least(len(s1), len(s2)) + 1)) AS i FROM featured))", FEATURED),
    "structured_match": _with("SELECT id1, id2, structured AS is_match, confidence FROM structured", FEATURED),
    "pair_edit_distance": _with("SELECT id1, id2, levenshtein(n1, n2) AS distance FROM featured", FEATURED),
    "pair_lcs": _with(
        "SELECT id1, id2, coalesce(list_max(list_transform(list_filter(flatten(list_transform(range(1, length(n1) + 1), "
        "lambda i: list_transform(range(1, length(n1) - i + 2), lambda l: substring(n1, i, l)))), "
        "lambda s: contains(n2, s)), lambda s: length(s))), 0) AS lcs_length FROM featured", FEATURED),
    "overlap_coefficient": _with(
        "SELECT id1, id2, CASE WHEN n1 = '' OR n2 = '' THEN 0.0 ELSE CAST(len(list_intersect(list_distinct("
        "string_split(n1, '')), list_distinct(string_split(n2, '')))) AS DOUBLE) / least(len(list_distinct("
        "string_split(n1, ''))), len(list_distinct(string_split(n2, '')))) END AS coefficient FROM featured", FEATURED),
    "pair_ratio": _with("SELECT id1, id2, ratio FROM featured JOIN ratios ON n1 = a AND n2 = b", FEATURED, RATIO),
    "pair_fuzzy": _with(
        f"SELECT id1, id2, CASE WHEN t1 = t2 THEN 'exact' WHEN {_fuzzy(BY_RATIO)} THEN 'fuzzy' END AS match_type "
        "FROM structured JOIN ratios ON n1 = a AND n2 = b", FEATURED, RATIO),
    "pair_match_type": _with(
        "SELECT id1, id2, match_type, match_type IS NOT NULL AS is_match FROM scored",
        _scored("all_pairs", FULL_TYPE, with_score=False)),
    "pair_score": _with("SELECT id1, id2, similarity_score FROM scored", _scored("all_pairs", FULL_TYPE)),
    "matched_strict": _with(f"SELECT {RESULT}, match_type FROM compared WHERE match_type IS NOT NULL", STRICT, COMPARED),
    "matched_structured": _with(
        f"SELECT {RESULT}, match_type FROM compared WHERE match_type IS NOT NULL",
        _scored("joined_pairs", STRUCTURED_TYPE, with_ratio=False), COMPARED),
    "matched": _with(
        f"SELECT {RESULT}, match_type, similarity_score FROM compared WHERE match_type IS NOT NULL",
        _scored("joined_pairs", FULL_TYPE), COMPARED),
    "award_differs_strict": _with(
        f"SELECT award_id, {RESULT}, 'no_match' AS match_type FROM compared WHERE match_type IS NULL", STRICT, COMPARED),
    "award_differs": _with(
        f"SELECT award_id, {RESULT}, 'no_match' AS match_type, similarity_score FROM compared WHERE match_type IS NULL",
        _scored("joined_pairs", FULL_TYPE), COMPARED),
    "absent_from_corpus": _with("SELECT * FROM absent", ABSENT),
    "dois_not_in_input": _with(
        f"SELECT DISTINCT g.doi FROM grants g LEFT JOIN input i ON g.doi = i.doi WHERE g.funder = '{FUNDER}' AND i.doi IS NULL"),
    "candidate_pairs": _with(
        "SELECT segment, corpus_awards, input_awards, corpus_awards * input_awards AS candidate_pairs "
        "FROM (SELECT segment, count(*) AS corpus_awards FROM corpus_index GROUP BY segment) "
        "JOIN (SELECT segment, count(*) AS input_awards FROM input_index GROUP BY segment) USING (segment)", OVERLAP),
    "best_overlap_match": _with(
        "SELECT id1 AS award_id, id2 AS matching_input_award_id, exact, CAST(gap AS INTEGER) AS length_gap FROM best", OVERLAP),
    "award_overlap": _with(
        "SELECT id1 AS award_id, id2 AS matching_input_award_id, match_type, similarity_score FROM scored",
        OVERLAP, BEST_SCORED),
    "corpus_only": _with(
        "SELECT corpus_only.*, similarity_score FROM corpus_only "
        "LEFT JOIN scored ON award_id = id1 AND matching_input_award_id = id2", OVERLAP, CORPUS_ONLY, BEST_SCORED),
    "consolidated_report": _with("SELECT * FROM consolidated", ALL_RESULTS),
    "result_files": _with("SELECT category AS name, count(*) AS rows FROM consolidated GROUP BY category", ALL_RESULTS),
    "result_counts": _with("SELECT category, count(*) AS n FROM consolidated GROUP BY category", ALL_RESULTS),
    "match_type_breakdown": _with(
        f"SELECT {_types('true', '', '_matches')} FROM compared",
        _scored("joined_pairs", FULL_TYPE, with_score=False), COMPARED),
    "overlap_breakdown": _with(
        "SELECT count(*) AS total_not_matched_by_doi, count(*) FILTER (WHERE has_award_overlap) AS with_award_overlap, "
        "count(*) FILTER (WHERE NOT has_award_overlap) AS truly_missing, "
        f"{_types('has_award_overlap', 'overlap_', '')} FROM corpus_only", OVERLAP, CORPUS_ONLY),
    "overlap_from_no_doi": _with(
        "SELECT count(*) FILTER (WHERE has_award_overlap AND matching_input_award_id IN "
        "(SELECT award_id FROM input WHERE doi IS NULL AND award_id IS NOT NULL)) AS overlap_from_no_doi, "
        "count(*) FILTER (WHERE award_id IS NULL) AS rows_without_award_id FROM corpus_only", OVERLAP, CORPUS_ONLY),
    "recon_stats": _with(_statistics(), ALL_RESULTS, SUMMARY),
    "recon_percentages": _with(
        "SELECT pct_work_and_award_matched, pct_work_matched_award_differs, pct_records_not_in_corpus FROM summary",
        ALL_RESULTS, SUMMARY),
    "report_lines": _with(_report_lines(), ALL_RESULTS, SUMMARY),
    "report_sheet": _with(_sheet(), ALL_RESULTS, SUMMARY),
    "build_over_existing": _with("SELECT *, true AS refused FROM grants"),
    "matched_all": _with(
        f'SELECT {RESULT}, funder, "list no.", match_type, similarity_score FROM compared WHERE match_type IS NOT NULL',
        _scored("joined_pairs", FULL_TYPE), COMPARED, ALL),
    "award_differs_all": _with(
        f"""SELECT award_id, {RESULT}, funder, "list no.", 'no_match' AS match_type FROM compared WHERE match_type IS NULL""",
        _scored("joined_pairs", STRUCTURED_TYPE, with_ratio=False), COMPARED, ALL),
    "largest_products_all": _with(
        "SELECT funder, doi, a.n * b.n AS pairs FROM (SELECT funder, doi, count(*) AS n FROM (SELECT DISTINCT * FROM input) "
        "WHERE funder IS NOT NULL GROUP BY funder, doi) a JOIN (SELECT funder, doi, count(*) AS n FROM mine "
        "GROUP BY funder, doi) b USING (funder, doi) ORDER BY pairs DESC, funder, doi LIMIT 10", ALL),
    "absent_from_corpus_all": _with("SELECT * FROM absent", ALL),
    "corpus_only_all": _with("SELECT * FROM corpus_only", OVERLAP, ALL),
    "recon_stats_all": _with(
        _statistics_all(), OVERLAP, _scored("joined_pairs", FULL_TYPE, with_score=False), COMPARED, CORPUS_ONLY, ABSENT,
        CONSOLIDATED, SUMMARY_ALL, ALL),
}
