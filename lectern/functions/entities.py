"""Entity types, entity lists and question lists as providers return them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import Text, col, strip

# Canonical types and the words that mean them.
TYPES = {
    "person": ("person", "per", "human", "individual"),
    "organization": ("organization", "organisation", "org", "company", "agency"),
    "system": ("system", "sys", "infrastructure", "platform"),
    "protocol": ("protocol", "standard"),
    "software": ("software", "app", "application", "program"),
    "location": ("location", "place", "city", "country", "region"),
    "concept": ("concept", "idea", "topic", "theme"),
    "product": ("product",),
}
TYPE_OF = {word: name for name, listed in TYPES.items() for word in listed}
ENTITIES = "array<struct<name:string,type:string,aliases:array<string>>>"


def entity_type(raw: Text) -> Column:
    """The canonical type of a free-text type; null for unknown, null and blank ones."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(TYPE_OF.items())])
    return F.element_at(table, F.lower(strip(F.coalesce(col(raw), F.lit("")))))


#: Where the JSON of a response may stand, whatever is written around it: an object that no list precedes, a list of objects, any list.
SPANS = (r"(?s)^[^\[{]*(\{.*\})", r"(?s)(\[\s*\{.*\}\s*\])", r"(?s)(\[.*\])")


def entities_from_response(raw: Text, unknown_type: str = "keep") -> Column:
    """Entities of a response: a JSON list of objects, an object that holds one, or one object, with or without text around it.

    Unusable parts are left out, an unusable response gives none. A name is required; of the aliases only texts count, blank ones
    not. unknown_type: 'keep' leaves a type outside of the vocabulary as it is ('concept' if empty), 'drop' leaves the entity out.
    """
    parsed = F.coalesce(*[F.try_parse_json(F.regexp_extract(col(raw), span, 1)) for span in SPANS])
    listed = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    text = lambda v, path: strip(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))
    items = lambda v: F.coalesce(listed(v, "$"), listed(v, "$.entities"), listed(v, "$.entity"), F.array(v))

    def entity(v: Column) -> Column:
        kind = text(v, "$.type")
        aliases = F.filter(F.coalesce(listed(v, "$.aliases"), F.expr("cast(array() as array<variant>)")), lambda a: F.schema_of_variant(a) == "STRING")
        named = F.filter(F.transform(aliases, lambda a: strip(F.try_variant_get(a, "$", "string"))), lambda a: a != "")
        known = F.coalesce(entity_type(kind), F.lit(None) if unknown_type == "drop" else F.when(kind == "", "concept").otherwise(kind))
        return F.struct(text(v, "$.name").alias("name"), known.alias("type"), named.alias("aliases"))

    every = F.transform(F.element_at(F.transform(F.array(parsed), items), 1), entity)
    return F.coalesce(F.filter(every, lambda e: (e["name"] != "") & e["type"].isNotNull()), F.array().cast(ENTITIES))


def questions_from_response(raw: Text, most: int = 10) -> Column:
    """Questions of a response: a JSON list of strings, else its lines that end with '?', at most ``most``."""
    text = col(raw)
    listed = F.from_json(text, "array<string>")
    from_list = F.filter(F.transform(listed, lambda q: strip(F.coalesce(q, F.lit("")))), lambda q: q != "")
    lines = F.transform(F.split(text, r"\R"), lambda x: strip(F.regexp_replace(strip(x), r"^-+", "")))
    from_lines = F.filter(lines, lambda q: q.endswith("?"))
    is_list = F.regexp_extract(text, r"^\s*(\[|\{)", 1)
    return F.slice(F.when((is_list == "[") & listed.isNotNull(), from_list).when(is_list == "{", F.array().cast("array<string>")).otherwise(from_lines), 1, most)


def alias_display(aliases: Text) -> Column:
    """Aliases as one line; a JSON text that is no list shows as it is."""
    a = col(aliases)
    return F.coalesce(F.array_join(F.from_json(a, "array<string>"), ", "), a, F.lit(""))


def aliases_from_line(line: Text) -> Column:
    """A comma-separated line as a list without blanks."""
    return F.filter(F.transform(F.split(col(line), ","), strip), lambda a: a != "")
