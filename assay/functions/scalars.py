"""Scalar functions of the warehouse as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Visibilities in C#, test attributes by framework (order counts: the first framework that matches wins).
VISIBILITIES = {"public": "public", "private": "private", "protected": "protected", "internal": "internal", "protectedinternal": "protected internal", "privateprotected": "private protected"}
FRAMEWORKS = {
    "NUnit": ("Test", "TestCase", "TestCaseSource", "Theory"),
    "xUnit": ("Fact", "Theory"),
    "MSTest": ("TestMethod", "DataSource"),
    "Microsoft.VisualStudio.TestTools.UnitTesting": ("TestMethod", "DataSource"),
}


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


def simple_name(name: Column) -> Column:
    """Text after the last dot, also where the dot is in an argument."""
    return F.substring_index(name, ".", -1)


def complexity_name(name: Column) -> Column:
    """Of ``A::B::f( int x )``: after the last ``::``, before the first parenthesis, trimmed."""
    return F.trim(F.substring_index(F.substring_index(name, "::", -1), "(", 1))


def path_tail(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_norm(path: Column, root: str = "/app/project/") -> Column:
    return F.substring_index(path, root, -1)


def visibility(modifiers: Column) -> Column:
    """The first modifier that is a visibility; ``internal`` without one."""
    clean = F.transform(modifiers, lambda m: F.lower(F.trim(m)))
    names = F.create_map(*(F.lit(x) for pair in VISIBILITIES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.get(F.filter(clean, lambda m: m.isin(*VISIBILITIES)), F.lit(0))), F.lit("internal"))


def framework_from_usings(usings: Column, frameworks: dict[str, tuple[str, ...]] = FRAMEWORKS) -> Column:
    """Of the usings that name a framework (any case), the last; of several frameworks in it, the last."""
    hits = F.flatten(F.transform(usings, lambda u: F.filter(F.array(*map(F.lit, frameworks)), lambda f: F.contains(F.lower(u), F.lower(f)))))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(""))


def test_framework(attributes: Column, frameworks: dict[str, tuple[str, ...]] = FRAMEWORKS) -> Column:
    """The first framework with one of the attributes, exactly spelled; null for none."""
    found = F.lit(None).cast("string")
    for name, marks in reversed(frameworks.items()):
        found = F.when(F.exists(attributes, lambda a: a.isin(*marks)), name).otherwise(found)
    return found


def is_assertion(text: Column) -> Column:
    return F.contains(text, F.lit("Assert"))


def coverage_name_kept(name: Column, compat: bool = True) -> Column:
    """Names of accessors and constructors are skipped: any that contain get, set or .ctor; with ``compat`` off, only real ones."""
    if compat:
        return ~(F.contains(name, F.lit("get")) | F.contains(name, F.lit("set")) | F.contains(name, F.lit(".ctor")))
    return coverage_lookup_kept(name)


def coverage_lookup_kept(name: Column) -> Column:
    return ~((name == ".ctor") | name.startswith("get_") | name.startswith("set_"))


def percent(rate: Column) -> Column:
    """Whole percent, cut off; null stays null."""
    return (rate * 100).cast("int")


def run_description(percentage: Column) -> Column:
    return F.when(percentage > 0, "Success: Coverage Found").otherwise("Failed: Zero Coverage Found")


def run_id_tag(unique: Column, baseline: Column) -> Column:
    return F.when(baseline, F.concat(F.lit("baseline_"), unique)).otherwise(unique)


def json_list(values: Column) -> Column:
    """A JSON list; a null list is the text null."""
    return F.coalesce(F.to_json(values), F.lit("null"))


def code_block(response: Column) -> Column:
    """Text in the first pair of fences, without the word csharp, trimmed; the whole text without a pair."""
    fence = F.try_element_at(F.split(response, "```"), F.lit(2))
    return F.trim(F.replace(F.coalesce(F.when(F.size(F.split(response, "```")) > 2, fence), response), F.lit("csharp"), F.lit("")))


def test_prompt(method: Column, test: Column, test_class: Column, dependencies: Column, framework: Column, logs: Column | None = None) -> Column:
    """A request for a further test; with ``logs`` of a failed run, for its repair."""
    parts = [F.lit("Write one "), framework, F.lit(" test method for:\n"), method, F.lit("\nAn existing test:\n"), test, F.lit("\nIn the class:\n"), test_class, F.lit("\nUsings:\n"), dependencies, F.lit("\nGive only the method, between two lines of ```.")]
    if logs is not None:
        parts += [F.lit("\nThe last attempt failed with:\n"), logs]
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


#: Fixed value: what a log says where coverage can't be had on other systems.
WINDOWS_ONLY = "Code coverage is currently supported only on Windows."


def windows_only(log: Column) -> Column:
    """Whether a log's text holds the message, in any case."""
    return F.contains(F.lower(log), F.lit(WINDOWS_ONLY.lower()))


def complexity_value(text: Column) -> Column:
    """The number in a text, 0.0 where it has none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
