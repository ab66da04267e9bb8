"""Enriched context: prompts, answers and the text that is embedded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The labels of an answer's lines and the fields that they fill.
TEXTS = {"SUMMARY": "summary", "PURPOSE": "purpose"}
LISTS = {"CONCEPTS": "related_concepts", "USAGE": "usage_patterns", "DEPENDENCIES": "dependencies"}
#: Characters of a related chunk that a prompt quotes.
RELATED = 500

_EXAMPLE = """```python
def retry(call, times):
    ...
```
SUMMARY: retry a call a bounded number of times
PURPOSE: survive passing failures
CONCEPTS: retry, backoff, exception, loop, callable, resilience
USAGE: network calls, flaky services
DEPENDENCIES: none"""


def prompt(chunk: Mapping[str, object], template: str = "", related: Sequence[Mapping[str, object]] = ()) -> str:
    """The prompt for a chunk. A template's six placeholders are filled one after the other, each where
    it first stands; without a template a built-in prompt with an example is used."""
    path = str(chunk["file_path"])
    if template:
        for name, value in (("code", chunk["content"]), ("language", chunk["language"]), ("fileName", path.rsplit("/", 1)[-1]), ("filePath", path), ("startLine", chunk["start_line"]), ("endLine", chunk["end_line"])):
            template = template.replace("{" + name + "}", str(value), 1)
        return template
    near = [f"Related {k} ({r['file_path']}):\n```{r['language']}\n{str(r['content'])[:RELATED]}```" for k, r in enumerate(related, 1)]
    return "\n\n".join(
        [
            "Describe code for a search index. Answer in five labelled lines, as in this example.",
            _EXAMPLE,
            f"File {path}, lines {chunk['start_line']}-{chunk['end_line']}:\n```{chunk['language']}\n{chunk['content']}\n```",
            *near,
            "SUMMARY: 5-10 words. PURPOSE: the intent. CONCEPTS: 6-10 keywords. USAGE: use cases. DEPENDENCIES: libraries and types. Separate items by commas.\nSUMMARY: ",
        ]
    )


def parse_context(answer: Column) -> Column:
    """A struct of an answer's labelled lines. A label stands at the start of its line, and its last
    line counts; texts without one are null, lists are empty. Blank values and items are dropped."""
    lines = F.split(F.coalesce(answer, F.lit("")), "\n", -1)

    def last(label: str) -> Column:
        named = F.filter(lines, lambda x: F.startswith(x, F.lit(label + ":")))
        return F.trim(F.substr(F.try_element_at(named, F.lit(-1)), F.lit(len(label) + 2)), F.lit(" \t\r"))

    texts = [F.nullif(last(k), F.lit("")).alias(v) for k, v in TEXTS.items()]
    split = lambda c: F.filter(F.transform(F.split(c, ",", -1), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    lists = [F.coalesce(split(last(k)), F.array().cast("array<string>")).alias(v) for k, v in LISTS.items()]
    return F.struct(*texts, *lists)


def full_context(chunk: dict[str, Column], context: dict[str, Column]) -> Column:
    """The text that describes a chunk; lines whose field is empty are left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    line = lambda label, c: F.concat(F.lit(label + ": "), some(c))
    items = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label + ": "), F.array_join(c, ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("File: "), chunk["file_path"]),
        line("Function", chunk["function_name"]),
        line("Class", chunk["class_name"]),
        line("Summary", context["summary"]),
        line("Purpose", context["purpose"]),
        items("Concepts", context["related_concepts"]),
        items("Usage", context["usage_patterns"]),
        items("Dependencies", context["dependencies"]),
        F.lit("\nCode:"),
        chunk["content"],
    )


def fallback_context(chunk: dict[str, Column]) -> Column:
    """What stands in for an answer when there is none."""
    fn, cls = (F.nullif(chunk[k], F.lit("")) for k in ("function_name", "class_name"))
    lines = F.concat(F.lit("Code in "), chunk["file_path"], F.lit(" lines "), chunk["start_line"].cast("string"), F.lit("-"), chunk["end_line"].cast("string"))
    summary = F.coalesce(F.concat(F.lit("Function "), fn, F.lit(" in "), chunk["file_path"]), lines)
    none = F.array().cast("array<string>")
    return F.struct(
        summary.alias("summary"), F.lit("Code implementation").alias("purpose"), F.when(cls.isNotNull(), F.array(cls)).otherwise(none).alias("related_concepts"),
        none.alias("usage_patterns"), none.alias("dependencies"), F.concat(summary, F.lit("\n\n"), chunk["content"]).alias("full_context"),
    )
