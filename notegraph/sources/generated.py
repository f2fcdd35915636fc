"""Notes made from identifiers: five kinds, in two languages, the same on every run.

Whatever varies is arithmetic on the identifier, so a note does not depend on how the
identifiers are dealt over partitions, and SQL can say what the engine should find in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders by identifier modulo 5.
KINDS = ("projects", "people", "reference", "meetings", "daily")
_PRIME, _FACTOR, _STEP = 2147483647, 1103515245, 7919
#: A paragraph of 400 characters.
PARAGRAPH = "lorem " * 66 + "end."
#: (number, of how many): what is drawn for each note.
DRAWS = {"spanish": (1, 7), "area": (2, 9), "person": (3, 50), "risky": (4, 2), "code": (5, 2), "irish": (6, 4), "project": (7, 40), "paras": (8, 7), "day": (9, 700), "bare": (10, 3), "ref": (11, 30)}


def draw(name: str, seed: int = 0, id: Column | None = None) -> Column:
    """A number from 0 below the range of ``name``, the same for equal identifiers and seeds."""
    number, n = DRAWS[name]
    mixed = ((F.col("id") if id is None else id) % _PRIME * _FACTOR + F.lit((number + 1000 * seed) * _STEP).cast("long")) % _PRIME
    return mixed * mixed % _PRIME % n


def draws_sql(id: str, seed: int = 0) -> str:
    """The same numbers as columns in SQL."""
    mixed = {k: f"(({id})::BIGINT % {_PRIME} * {_FACTOR} + {(number + 1000 * seed) * _STEP}) % {_PRIME}" for k, (number, _) in DRAWS.items()}
    return ", ".join(f"({m}) * ({m}) % {_PRIME} % {DRAWS[k][1]} AS {k}" for k, m in mixed.items())


def _lines(*parts: tuple[Column | bool, str]) -> Column:
    """The lines of the parts that hold, with {names} filled in from columns."""

    def fill(text: str) -> Column:
        pieces = [F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(text.replace("}", "{").split("{"))]
        return F.concat(*pieces)

    return F.concat_ws("\n", *[fill(text) if when is True else F.when(when, fill(text)) for when, text in parts])


def notes(ids: DataFrame, seed: int = 0) -> DataFrame:
    """``ids`` (id and others) with the path and text of one note each; ids are not below 0."""
    d = ids.withColumns({k: draw(k, seed) for k in DRAWS})
    es = F.col("spanish") == 0
    d = d.withColumns(
        {
            "title": F.concat(F.when(es, "Proyecto ñandú ").otherwise("Project "), F.col("id").cast("string")),
            "status": F.when(es, "Situación").otherwise("Status"), "decisions": F.when(es, "Decisión").otherwise("Decisions"), "context": F.when(es, "Contexto").otherwise("Context"),
            "name": F.concat(F.when(F.col("irish") == 0, "O'Neil ").otherwise("Person "), F.col("id").cast("string")),
            "about": F.concat(F.when(es, "Guía ").otherwise("Reference "), F.col("id").cast("string")),
            "date": F.date_add(F.lit("2023-01-01").cast("date"), F.col("day").cast("int")).cast("string"),
            "body": F.repeat(F.lit(PARAGRAPH + "\n\n"), F.col("paras").cast("int")),
        }
    )
    risky, code = F.col("risky") == 1, F.col("code") == 1
    texts = [
        _lines(
            (True, '---\ntitle: {title}\naliases: [P{id}, "{title}"]\ntags: project, Area/{area}\ncreated: {date}\n---\nOwner: [[people/Person {person}|Ana]]\n\n# {status}'),
            (risky, "> [!warning]- Risk\n> of delay\n"), (True, "Going ==well== #active/{area}\n\n### {decisions}"), (code, "~~~~ bash\n# not a heading\n~~~\necho {id}\n~~~~~"),
            (True, "Done[^1] ^b{id}\n## Related\n![[Reference {ref}]] and ![[plan.png]] [map](ref/r{ref}.md)"),
        ),
        _lines((True, "---\nalias: N{id}\ntags:\n  - person\n  - '#Person'\n---\n## {context}\nMet in [[Project {project}#Plan]].\n\n## Threads\n- [[Project {project}]]\n- [[projects/Project {project}]]")),
        _lines((True, "# {about}\nLead.\n## One\n{body}## Two"), (code, "```python\ny = [[none]]\n```\n```dataview\nlist\n```"), (True, "tail\n%% hidden\nnote %%")),
        _lines((True, "Attendees: [[Person {person}|P]], [[people/Person {person}]]\n\n## Tasks ##\n- [ ] write #todo/{area}\n<!-- private\nnote -->")),
        _lines((True, "## Morning\n\n## Evening"), (F.col("bare") > 0, "Tea ==hot== in Niño street #café")),
    ]
    names = ["{title}", "{name}", "{about}", "{date} Sync {id}", "{date} {id}"]
    kind = F.col("id") % 5

    def by_kind(values: list[Column]) -> Column:
        out = F.when(kind == 0, values[0])
        for k in range(1, 5):
            out = out.when(kind == k, values[k])
        return out

    path = by_kind([F.concat(F.lit(f"{folder}/"), _lines((True, n)), F.lit(".md")) for folder, n in zip(KINDS, names)])
    return d.select(*ids.columns, path.alias("path"), by_kind(texts).alias("text"))


def vault(spark: SparkSession, n: int = 120, seed: int = 0) -> DataFrame:
    """(path, text) of ``n`` notes and of three files that a scan must leave out."""
    left_out = [(".obsidian/plugins/readme.md", "# no note"), ("attachments/plan.png", "png"), ("people/Person 1.sync-conflict-20240101.md", "# a copy")]
    return notes(spark.range(n), seed).select("path", "text").unionByName(spark.createDataFrame(left_out, "path string, text string"))


def expected_sql(table: str, key: str) -> str:
    """Views ``g`` (a note with its draws), ``g_meta``, ``g_sections`` and ``g_fences``: what the notes
    of ``key`` in ``table`` hold, by construction."""
    nl = "chr(10)"
    return f"""g AS (SELECT *, CASE WHEN spanish = 0 THEN 'Proyecto ñandú ' ELSE 'Project ' END || id AS title, CASE WHEN spanish = 0 THEN 'Guía ' ELSE 'Reference ' END || id AS about,
    CASE WHEN irish = 0 THEN 'O''Neil ' ELSE 'Person ' END || id AS person_name, (DATE '2023-01-01' + day::INT)::VARCHAR AS date, CASE WHEN spanish = 0 THEN 'Situación' ELSE 'Status' END AS status
    FROM (SELECT {key}::BIGINT AS id, {draws_sql(key)} FROM {table})),
g_meta AS (SELECT id, 'projects/' || title || '.md' AS path, title, 'P' || id || '|' || title AS aliases, 'project|Area/' || area || '|active/' || area AS tags, 'people/Person ' || person || '|ref/r' || ref || '.md' AS links, 'Reference ' || ref AS embeds FROM g WHERE id % 5 = 0
  UNION ALL SELECT id, 'people/' || person_name || '.md', person_name, 'N' || id, 'person', 'Project ' || project || '|projects/Project ' || project, '' FROM g WHERE id % 5 = 1
  UNION ALL SELECT id, 'reference/' || about || '.md', about, '', '', '', '' FROM g WHERE id % 5 = 2
  UNION ALL SELECT id, 'meetings/' || date || ' Sync ' || id || '.md', date || ' Sync ' || id, '', 'todo/' || area, 'Person ' || person || '|people/Person ' || person, '' FROM g WHERE id % 5 = 3
  UNION ALL SELECT id, 'daily/' || date || ' ' || id || '.md', date || ' ' || id, '', CASE WHEN bare > 0 THEN 'café' ELSE '' END, '', '' FROM g WHERE id % 5 = 4),
g_sections AS (SELECT id, 0 AS n, 0 AS level, title AS heading, '' AS trail, 7 AS start_line, 'Owner: Ana' AS body FROM g WHERE id % 5 = 0
  UNION ALL SELECT id, 1, 1, status, '', 9, CASE WHEN risky = 1 THEN 'Warning: Risk' || {nl} || 'of delay' || {nl} || {nl} ELSE '' END || 'Going well active/' || area FROM g WHERE id % 5 = 0
  UNION ALL SELECT id, 2, 3, CASE WHEN spanish = 0 THEN 'Decisión' ELSE 'Decisions' END, status, 12 + 3 * risky,
    CASE WHEN code = 1 THEN '~~~~ bash' || {nl} || '# not a heading' || {nl} || '~~~' || {nl} || 'echo ' || id || {nl} || '~~~~~' || {nl} ELSE '' END || 'Done' FROM g WHERE id % 5 = 0
  UNION ALL SELECT id, 3, 2, 'Related', status, 14 + 3 * risky + 5 * code, '[embeds: Reference ' || ref || '] and  map' FROM g WHERE id % 5 = 0
  UNION ALL SELECT id, 0, 0, person_name, '', 7, '' FROM g WHERE id % 5 = 1
  UNION ALL SELECT id, 1, 2, CASE WHEN spanish = 0 THEN 'Contexto' ELSE 'Context' END, '', 7, 'Met in Project ' || project || ' Plan.' FROM g WHERE id % 5 = 1
  UNION ALL SELECT id, 2, 2, 'Threads', '', 10, '- Project ' || project || {nl} || '- Project ' || project FROM g WHERE id % 5 = 1
  UNION ALL SELECT id, 0, 0, about, '', 1, '' FROM g WHERE id % 5 = 2
  UNION ALL SELECT id, 1, 1, about, '', 1, 'Lead.' FROM g WHERE id % 5 = 2
  UNION ALL SELECT id, 2, 2, 'One', about, 3, rtrim(repeat('{PARAGRAPH}' || {nl} || {nl}, paras::INT), {nl}) FROM g WHERE id % 5 = 2
  UNION ALL SELECT id, 3, 2, 'Two', about, 4 + 2 * paras, CASE WHEN code = 1 THEN concat_ws({nl}, '```python', 'y = [[none]]', '```', '```dataview', 'list', '```', '') ELSE '' END || 'tail' FROM g WHERE id % 5 = 2
  UNION ALL SELECT id, 0, 0, date || ' Sync ' || id, '', 1, 'Attendees: P, Person ' || person FROM g WHERE id % 5 = 3
  UNION ALL SELECT id, 1, 2, 'Tasks', '', 3, '- [ ] write todo/' || area FROM g WHERE id % 5 = 3
  UNION ALL SELECT id, 0, 0, date || ' ' || id, '', 1, '' FROM g WHERE id % 5 = 4
  UNION ALL SELECT id, 1, 2, 'Morning', '', 1, '' FROM g WHERE id % 5 = 4
  UNION ALL SELECT id, 2, 2, 'Evening', '', 3, CASE WHEN bare > 0 THEN 'Tea hot in Niño street café' ELSE '' END FROM g WHERE id % 5 = 4),
g_fences AS (SELECT id, unnest(range(12 + 3 * risky, 17 + 3 * risky)) AS n, 'bash' AS lang FROM g WHERE id % 5 = 0 AND code = 1
  UNION ALL SELECT id, unnest(range(4 + 2 * paras, 7 + 2 * paras)), 'python' FROM g WHERE id % 5 = 2 AND code = 1
  UNION ALL SELECT id, unnest(range(7 + 2 * paras, 10 + 2 * paras)), 'dataview' FROM g WHERE id % 5 = 2 AND code = 1)"""
