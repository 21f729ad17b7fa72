"""Filters, projection, changes and validation of JSON documents, and full-text search.

Values have JSON's types: text operators match strings alone, numbers compare with numbers of
either kind, and a field that is missing is not one that is null.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def _steps(dotted: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def path(doc: str, dotted: str) -> Column:
    """Text of the value at a dotted path; numbers index arrays."""
    return F.get_json_object(F.col(doc), _steps(dotted))


def _once(value: Column, body) -> Column:
    """body over a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def value(doc: str, dotted: str) -> Column:
    """The value as a variant; null where it is missing or the document is no JSON."""
    return F.try_variant_get(F.try_parse_json(F.col(doc)), _steps(dotted), "variant")


def kind(variant: Column) -> Column:
    """string, int, float, bool, array, object or null; null where there is no value."""

    def named(t: Column) -> Column:
        out = F.when(t == "STRING", "string").when((t == "BIGINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), "int").when(_is_number(t), "float").when(t == "BOOLEAN", "bool")
        return out.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "VOID", "null")

    return _once(F.schema_of_variant(variant), named)


def _is_number(t: Column) -> Column:
    return t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def exists(doc: str, dotted: str) -> Column:
    """True where the field is there, a null value included."""
    return value(doc, dotted).isNotNull()


def _compare(v: Column, dotted: str, op: str, other: Any) -> Column:
    """Values are compared first, and types only where that holds."""
    at = _steps(dotted)
    t = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
    get = lambda as_: F.try_variant_get(v, at, as_)
    if other is None:
        test = t == "VOID"
    elif isinstance(other, bool):
        test = _holds(op, get("boolean"), F.lit(other)) & (t == "BOOLEAN")
    elif isinstance(other, (int, float)):
        test = _holds(op, get("double"), F.lit(float(other))) & _is_number(t)
    else:
        test = _holds(op, get("string"), F.lit(other)) & (t == "STRING")
    return F.coalesce(test, F.lit(False))


def _holds(op: str, a: Column, b: Column) -> Column:
    return {"$eq": a == b, "$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


def condition(doc: str, query: dict[str, Any]) -> Column:
    """A filter document as a two-valued column: $eq $ne $gt $gte $lt $lte $in $nin $exists
    $regex $contains $startsWith $endsWith, $and $or $not; several operators are ANDed. A field
    that is missing passes $ne and $nin alone; $contains also finds a member of an array; a
    pattern that is no regular expression matches nothing. A document is parsed once."""
    return _once(F.try_parse_json(F.col(doc)), lambda v: _condition(v, query))


def _condition(v: Column, query: dict[str, Any]) -> Column:
    out = F.lit(True)
    for key, want in query.items():
        if key == "$and":
            for q in want:
                out &= _condition(v, q)
        elif key == "$or":
            any_ = F.lit(False)
            for q in want:
                any_ |= _condition(v, q)
            out &= any_
        elif key == "$not":
            out &= ~_condition(v, want)
        else:
            for op, x in (want if isinstance(want, dict) else {"$eq": want}).items():
                out &= _operator(v, key, op, x)
    return out


def _operator(v: Column, key: str, op: str, x: Any) -> Column:
    if op in ("$in", "$nin"):
        found = F.lit(False)
        for item in x:
            found |= _compare(v, key, "$eq", item)
        return ~found if op == "$nin" else found
    if op == "$ne":
        return ~_compare(v, key, "$eq", x)
    one = F.try_variant_get(v, _steps(key), "variant")
    if op == "$exists":
        return one.isNotNull() if x else one.isNull()
    if op not in ("$regex", "$contains", "$startsWith", "$endsWith"):
        return _compare(v, key, op, x)
    text = F.try_variant_get(v, _steps(key), "string")
    of_string = lambda test: F.coalesce(test & (F.schema_of_variant(one) == "STRING"), F.lit(False))
    if op == "$regex":
        try:
            re.compile(x)
        except re.error:
            return F.lit(False)
        return of_string(text.rlike(x))
    if op == "$contains":
        found = of_string(text.contains(x)) if isinstance(x, str) else F.lit(False)
        members = F.transform(F.try_variant_get(v, _steps(key), "array<variant>"), lambda i: F.to_json(i))
        return found | F.coalesce(F.array_contains(members, json.dumps(x, ensure_ascii=False)), F.lit(False))
    return of_string(text.startswith(x) if op == "$startsWith" else text.endswith(x))


def find(docs: DataFrame, doc: str, query: dict[str, Any], sort: list[Column] | None = None, skip: int = 0, limit: int | None = None, project: dict[str, str] | None = None) -> DataFrame:
    """Filter, sort, skip, limit, project, in that order."""
    out = docs.where(condition(doc, query))
    if sort:
        out = out.orderBy(*sort)
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select("*", *[path(doc, p).alias(n) for n, p in project.items()]).drop(doc) if project else out


class DocQuery:
    """Builds a filter document: `DocQuery().eq("a", 1).gt("b", 2).sort(...).limit(5).run(docs, "doc")`."""

    def __init__(self):
        self._and: list[dict] = []
        self._sort, self._skip, self._limit, self._project = [], 0, None, None

    def _add(self, field: str, op: str, x: Any) -> "DocQuery":
        self._and.append({field: {op: x}})
        return self

    def __getattr__(self, name: str):
        op = {"in_": "$in", "starts_with": "$startsWith", "ends_with": "$endsWith"}.get(name, f"${name}")
        if op not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$contains", "$startsWith", "$endsWith"):
            raise AttributeError(name)
        return lambda field, x=True: self._add(field, op, x)

    def any_of(self, *queries: "DocQuery") -> "DocQuery":
        self._and.append({"$or": [q.filter() for q in queries]})
        return self

    def all_of(self, *queries: "DocQuery") -> "DocQuery":
        self._and += [q.filter() for q in queries]
        return self

    def none_of(self, query: "DocQuery") -> "DocQuery":
        self._and.append({"$not": query.filter()})
        return self

    def sort(self, *columns: Column) -> "DocQuery":
        self._sort += columns
        return self

    def skip(self, n: int) -> "DocQuery":
        self._skip = n
        return self

    def limit(self, n: int) -> "DocQuery":
        self._limit = n
        return self

    def project(self, **fields: str) -> "DocQuery":
        self._project = fields
        return self

    def filter(self) -> dict:
        return {"$and": self._and}

    def run(self, docs: DataFrame, doc: str) -> DataFrame:
        return find(docs, doc, self.filter(), self._sort, self._skip, self._limit, self._project)


def patch(doc: str, changes: dict[str, Column]) -> Column:
    """Shallow merge into the top level of a JSON object: new values replace old ones, all keep their types."""
    base = F.from_json(F.col(doc), "map<string,variant>")
    kept = F.map_filter(base, lambda k, v: ~k.isin(*changes))
    return F.to_json(F.map_concat(kept, F.create_map(*[c for k, v in changes.items() for c in (F.lit(k), v.cast("variant"))])))


def insert(docs: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The documents with the new ones, and the new ones that are refused as their id is taken
    (of new ones with one id, the first by their text is taken)."""
    taken = docs.select(key)
    order = F.struct(*[c for c in new.columns if c != key])
    first = new.groupBy(key).agg(F.min(order).alias("_row")).select(key, "_row.*").select(*new.columns)
    good = first.join(taken, key, "left_anti")
    return docs.unionByName(good), new.exceptAll(good)


def replace(docs: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The documents with those of the same id replaced, and the new ones that have nothing to replace."""
    known = new.join(docs.select(key), key, "left_semi")
    return docs.join(known, key, "left_anti").unionByName(known), new.join(docs.select(key), key, "left_anti")


def delete(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The documents without those ids, and the ids that were not there."""
    return docs.join(ids, key, "left_anti"), ids.join(docs.select(key), key, "left_anti")


def errors(doc: str, rules: dict[str, dict[str, Any]], additional: bool = True) -> Column:
    """Messages `field: rule` of the broken rules of each field: required; type (string, int,
    float, number, bool, array, object); nullable (false: a null is an error); min, max of numbers;
    min_length, max_length in bytes of strings and items of arrays; pattern; enum; items (type of
    all items); properties (rules of an object's fields). Rules other than required hold for fields that are
    there; those of a type hold for values of that type. Without `additional`, other fields of the document are errors."""
    of_rules = lambda v: F.flatten(F.array(F.array().cast("array<string>"), *_messages(v, rules, "")))
    found = _once(F.try_parse_json(F.col(doc)), of_rules)
    if not additional:
        extra = F.filter(F.json_object_keys(F.col(doc)), lambda key: ~key.isin(*rules))
        message = lambda e: F.when(F.size(e) > 0, F.concat(F.lit("additional: "), F.array_join(F.array_sort(e), " ")))
        found = F.concat(found, F.array(_once(extra, message)))
    return F.filter(found, lambda e: e.isNotNull())


def _messages(v: Column, rules: dict[str, dict[str, Any]], at: str) -> list[Column]:
    """Arrays with a message or null for each rule over a parsed document. A field's value and kind are found once."""
    found: list[Column] = []
    for field, rule in rules.items():
        name, tests = f"{at}{field}", []
        for test, x in [*rule.items(), ("properties", {})]:
            if test != "properties":
                tests.append((test, x))
                continue
            if tests:
                found.append(_field(v, name, tests))
                tests = []
            found += _messages(v, x, f"{name}.")
    return found


def _field(v: Column, name: str, tests: list[tuple[str, Any]]) -> Column:
    return _once(F.try_variant_get(v, _steps(name), "variant"), lambda one: _once(kind(one), lambda k: _broken(one, k, tests, name)))


def _broken(v: Column, k: Column, tests: list[tuple[str, Any], ...], name: str) -> Column:
    """Messages of one field of value v and kind k, or nulls."""
    get = lambda as_: F.try_variant_get(v, "$", as_)
    length = F.when(k == "string", F.octet_length(get("string"))).when(k == "array", F.size(get("array<variant>")))
    number = F.when(k.isin("int", "float"), get("double"))
    fits = lambda k, t: k.isin("int", "float") if t == "number" else k == t
    broken = {
        "required": lambda x: k.isNull() if x else F.lit(False),
        "type": lambda x: k.isNotNull() & (k != "null") & ~fits(k, x),
        "nullable": lambda x: k == "null" if not x else F.lit(False),
        "min": lambda x: number < x,
        "max": lambda x: number > x,
        "min_length": lambda x: length < x,
        "max_length": lambda x: length > x,
        "pattern": lambda x: (k == "string") & ~get("string").rlike(x),
        "enum": lambda x: k.isNotNull() & ~F.to_json(v).isin(*[json.dumps(i, ensure_ascii=False) for i in x]),
        "items": lambda x: F.exists(get("array<variant>"), lambda i: ~fits(kind(i), x)),
    }
    return F.array(*[F.when(F.coalesce(broken[test](x), F.lit(False)), F.lit(f"{name}: {test}")) for test, x in tests])


def terms(text: Column) -> Column:
    """Lower-case alphanumeric runs of two bytes or more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def wanted_terms(query: str) -> list[str]:
    return sorted({t for t in re.split(r"[^\w]+|_", query.lower()) if len(t.encode()) >= 2})


def search(docs: DataFrame, text: str, query: str, every: bool = True) -> DataFrame:
    """Documents with all (or any) of the query's terms; none for a query without terms."""
    wanted = wanted_terms(query)
    if not wanted:
        return docs.where(F.lit(False))
    # a term's text stands in the lower-cased document, which is cheaper to see than its terms
    low, tokens = F.lower(F.col(text)), terms(F.col(text))
    near, hit = F.lit(every), F.lit(every)
    for t in wanted:
        near = near & low.contains(t) if every else near | low.contains(t)
        hit = hit & F.array_contains(tokens, t) if every else hit | F.array_contains(tokens, t)
    return docs.where(F.when(near, hit).otherwise(F.lit(False)))


def term_counts(text: Column) -> Column:
    """Distinct terms of a text with their numbers, as an array of (term, n): the sorted terms' runs."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.coalesce(F.get(s, i - 1), F.lit(""))))
        counted = lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("n")))
        return F.transform(F.array(begins), counted)[0]

    none = F.array().cast("array<struct<term:string,n:bigint>>")
    return F.transform(F.array(F.sort_array(F.coalesce(terms(text), F.array().cast("array<string>")))), lambda s: F.when(F.size(s) == 0, none).otherwise(runs(s)))[0]


def inverted_index(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(term, key, n): the postings; write them partitioned or bucketed by term to search them again and again."""
    return docs.select(key, F.explode(term_counts(F.col(text))).alias("t")).select("t.term", key, "t.n")


def search_index(index: DataFrame, key: str, query: str, every: bool = True) -> DataFrame:
    """Keys of the documents with all (or any) of the query's terms, from the postings alone."""
    wanted = wanted_terms(query)
    met = index.where(F.col("term").isin(wanted)) if wanted else index.where(F.lit(False))
    out = met.groupBy(key).agg(F.count("*").alias("n"))
    return out.where(F.col("n") == len(wanted)).select(key) if every else out.select(key)
