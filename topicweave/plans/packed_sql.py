"""The rules for packed fields in SQL, to check the operator against."""

_BLANKS = r"'^\s+|\s+$', '', 'g'"


def packed_sql(name: str, relation: str, column: str, persons: bool = False) -> str:
    """CTEs that end in ``name(paper_id, pos, item)``: the values of a packed field."""
    sep = r"[;；|\n\r\t·、]|<br\s*/?>|\s/\s|\s-\s" + (r"|\s(?i:and)\s|\s&\s" if persons else "")
    cut = f"regexp_replace(p, '{sep}', chr(1), 'g')"
    comma = "replace(p, ',', chr(1))"
    if persons:
        whole = r"len(list_filter(string_split(p, ','), lambda x: NOT regexp_matches(x, '^\s*\S+\s+\S') OR regexp_full_match(x, '\s*(\p{Lu}\.?[\s-]*)+'))) = 0"
        comma = f"CASE WHEN len(l) > 1 OR ({whole} AND contains(p, ',')) THEN {comma} ELSE p END"
    listed = r"""regexp_matches(c, '^\[\s*[''"]')"""
    single = r"""regexp_matches(c, '^\[\s*''')"""
    inner = r"""regexp_replace(c, '^\[(.*)\]$', '\1')"""
    return f"""
{name}_0 AS (SELECT paper_id, regexp_replace({column}, {_BLANKS}) AS c FROM {relation} WHERE {column} IS NOT NULL),
{name}_1 AS (SELECT paper_id, CASE WHEN {single} THEN '''' ELSE '"' END AS q, CASE WHEN {listed} THEN {inner} ELSE c END AS b FROM {name}_0),
{name}_2 AS (SELECT paper_id, q, string_split(b, q) AS l FROM {name}_1),
{name}_3 AS (SELECT *, regexp_matches(array_to_string(list_filter(l, lambda x, i: i % 2 = 1), ' '), '{sep}') AS strong FROM {name}_2),
{name}_4 AS (SELECT paper_id, array_to_string(list_transform(l, lambda p, i: CASE WHEN i % 2 = 0 THEN p WHEN p = '' AND i > 1 AND i < len(l) THEN q WHEN strong THEN {cut} ELSE {comma} END), '') AS j FROM {name}_3),
{name}_5 AS (SELECT paper_id, list_filter(list_transform(string_split(j, chr(1)), lambda x: regexp_replace(x, {_BLANKS})), lambda x: x <> '') AS v FROM {name}_4),
{name} AS (SELECT paper_id, CAST(i - 1 AS INTEGER) AS pos, v[i] AS item FROM {name}_5, unnest(range(1, len(v) + 1)) u(i))"""
