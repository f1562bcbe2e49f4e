"""Features of a chunk, from its added lines and its path: one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.constants import (
    BRANCH_PATTERN,
    BUILTIN_CALLS,
    CALL_PATTERN,
    COMMENT_OPENERS,
    DEFINED_NAME_PATTERNS,
    ERROR_WORD_PATTERN,
    EXTENSION_CODES,
    FLAG_PATTERNS,
    FUNCTION_PATTERN,
    IMPORT_PATTERN,
    INDENT_UNIT,
    LONG_LINE,
    LOOP_PATTERN,
    MAGIC_NUMBER_PATTERN,
    VECTOR_COLUMNS,
)
from patchloom.functions.regex import INLINE_SPACE, SPACE, folded_pattern, opening, pattern
from patchloom.functions.text import contains_any, extension, folded, occurrences, ratio4

SEMANTIC_COLUMNS = ["cross_function_calls", "import_complexity", "error_handling_ratio"]

# Every match of a pattern contains one of these (folded where the pattern is searched so). A byte
# search for them spares most texts the pattern.
_NEEDLES = {
    "has_eval_exec": ["eval", "exec", "compile"],
    "has_sql_statement": ["select", "insert", "update", "delete", "drop"],
    "has_sql_fstring": ["f\"", "f'"],
    "has_shell_command": ["os.system", "subprocess.", "exec(", "child_process"],
    "has_hardcoded_secret": ["password", "secret", "api_key", "token", "auth"],
    "has_todo_fixme": ["todo", "fixme", "hack", "xxx", "bug"],
    "has_type_cast": ["int", "float", "str", "bool", "number", "parse"],
    "has_null_check": ["is none", "= none", "= null", "??"],
    "has_exception_handling": ["try", "except", "catch", "finally", "throw", "raise"],
    "has_file_io": ["open(", "readfile", "writefile", "fs.", "fopen", "fwrite"],
    "has_network_call": ["fetch(", "requests.", "http.", "axios.", "urllib", "httpx", "curl"],
    "has_print_debug": ["print(", "console.log", "system.out.print", "fmt.print", "println!"],
}
# The needles also open every match, but for these.
_OPENERS = {"has_null_check": ["is none", "== n", "!= n", "=== null", "!== null", "??"]}
_FUNCTION_NEEDLES = ["def", "func", "fn", "public", "private", "const"]
_DEFINED_NEEDLES = [["def", "func", "fn"], ["const"]]
_ERROR_NEEDLES = ["try", "except", "catch"]


# Cheaper forms of the same searches. A look at the next character first spares most positions the
# rest; a name followed by something that is no word character needs no backing up. A name before
# "= function" can start only where a word starts, or where a match that ended in "function" left off.
_BRANCHES = pattern(opening(["if", "else", "elif", "switch", "case", "when"]) + BRANCH_PATTERN)
_LOOPS = pattern(opening(["for", "while", "do", ".forEach", ".map", ".filter"]) + LOOP_PATTERN, opens_word=False)
_MAGIC_NUMBERS = pattern(r"(?=\d\d)" + MAGIC_NUMBER_PATTERN)
_CALLS = pattern(CALL_PATTERN.replace(r"\w+", r"\w++").replace(r"\s*", r"\s*+"))
_ASSIGNED_FUNCTION = r"|\w+\s*=\s*(async\s+)?function"
_HAS_ASSIGNED_FUNCTION = pattern(r"=\s*+(async\s++)?function")
_IMPORTS = pattern(IMPORT_PATTERN.replace(r"^\s*", f"^[{INLINE_SPACE}]*+"))
# One line may be very long and hold very many openings of a match. The first opening of a line has
# the longest rest, so it decides for the line, and an atomic group keeps the search from trying the
# others. A verb at the end of a line goes on in the next line that is not blank.
_VERB, _TARGET = FLAG_PATTERNS["has_sql_statement"].split(r"\s+.*")
_QUOTE, _QUOTED_VERB = FLAG_PATTERNS["has_sql_fstring"].split(".*?")
_OPENS_VERB = opening(_NEEDLES["has_sql_statement"])
_LINEAR_FLAGS = {
    "has_sql_statement": (
        rf"(?m)^(?>.*?{_OPENS_VERB}{_VERB}[{INLINE_SPACE}]).*{_TARGET}"
        rf"|{_OPENS_VERB}{_VERB}[{INLINE_SPACE}]*+\n\s*+.*{_TARGET}"
    ),
    "has_sql_fstring": rf"(?m)^(?>.*?{_QUOTE}).*?{_OPENS_VERB}{_QUOTED_VERB}",
}
_OPENED_FLAGS = {name: opening(_OPENERS.get(name, _NEEDLES[name])) for name in FLAG_PATTERNS if name not in _LINEAR_FLAGS}
_DECLARED = opening(["def", "fn", "func", "public", "private", "const"]) + FUNCTION_PATTERN.replace(_ASSIGNED_FUNCTION, "")
_DECLARED_FUNCTIONS = folded_pattern(_DECLARED)
# no two of these match at one place, so the order of the last one does not matter
_FUNCTIONS = folded_pattern(_DECLARED + r"|(?:(?<!\w)|(?<=function))(?=\w)\w++\s*+=\s*+(async\s++)?function")


def _count(text: Column, regex: str, needles: list[str] | None = None) -> Column:
    found = F.regexp_count(text, F.lit(regex))
    return F.when(contains_any(text, needles), found).otherwise(0) if needles else found


def _extract(text: Column, regex: str, needles: list[str]) -> Column:
    found = F.regexp_extract_all(text, F.lit(regex), 1)
    return F.when(contains_any(text, needles), found).otherwise(F.array().cast("array<string>"))


def _flag(folded_code: Column, name: str) -> Column:
    regex = folded_pattern(_LINEAR_FLAGS[name] if name in _LINEAR_FLAGS else _OPENED_FLAGS[name] + FLAG_PATTERNS[name])
    return contains_any(folded_code, _NEEDLES[name]) & folded_code.rlike(regex)


def _size_columns(code: Column, folded_code: Column, lines: Column) -> dict[str, Column]:
    total = F.size(lines)
    return {
        "num_added_lines": total,
        "num_context_lines": F.size("context_lines"),
        "avg_line_length": F.when(
            total > 0, (F.length(code) - (total - 1)) / F.greatest(total, F.lit(1))
        ).otherwise(0.0),
        "max_line_length": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)),
        "num_long_lines": F.size(F.filter(lines, lambda l: F.length(l) > LONG_LINE)),
        "num_functions_changed": F.when(
            folded_code.contains("function") & folded_code.rlike(_HAS_ASSIGNED_FUNCTION), _count(folded_code, _FUNCTIONS)
        ).otherwise(_count(folded_code, _DECLARED_FUNCTIONS, _FUNCTION_NEEDLES)),
    }


def _complexity_columns(code: Column) -> dict[str, Column]:
    indents = F.regexp_extract_all(code, F.lit(rf"(?dm)^([{INLINE_SPACE}]++)[^{SPACE}]"), 1)
    deepest = F.coalesce(F.array_max(F.transform(indents, F.length)), F.lit(0))
    assignments = [occurrences(code, sign) for sign in (" = ", " += ", " -= ")]
    return {
        "max_nesting_depth": F.floor(deepest / INDENT_UNIT).cast("int"),
        "num_branches": _count(code, _BRANCHES),
        "num_loops": _count(code, _LOOPS),
        "num_returns": occurrences(code, "return "),
        "num_assignments": assignments[0] + assignments[1] + assignments[2],
    }


def _flag_columns(folded_code: Column) -> dict[str, Column]:
    sql = ["has_sql_statement", "has_sql_fstring"]
    flags = {name: _flag(folded_code, name) for name in FLAG_PATTERNS if name not in sql}
    flags["has_sql_string"] = _flag(folded_code, sql[0]) | _flag(folded_code, sql[1])
    return flags


def _hygiene_columns(code: Column) -> dict[str, Column]:
    openers = "|".join(rf"\Q{opener}\E" for opener in COMMENT_OPENERS)
    return {
        "comment_lines": _count(code, rf"(?dm)^[{INLINE_SPACE}]*+(?:{openers})"),
        "num_magic_numbers": _count(code, _MAGIC_NUMBERS),
    }


def _path_columns(path: Column) -> dict[str, Column]:
    codes = F.create_map(*[F.lit(v) for item in EXTENSION_CODES.items() for v in item])
    return {
        "is_test_file": contains_any(F.lower(path), ["test", "spec"]),
        "file_extension_id": F.coalesce(F.try_element_at(codes, extension(path)), F.lit(0)),
    }


def _semantic_columns(code: Column) -> dict[str, Column]:
    called = _extract(code, _CALLS, ["("])
    defined = [
        _extract(code, pattern(regex), needles)
        for regex, needles in zip(DEFINED_NAME_PATTERNS, _DEFINED_NEEDLES)
    ]
    known = F.concat(*defined, F.array(*[F.lit(name) for name in BUILTIN_CALLS]))
    return {
        "cross_function_calls": F.size(F.array_except(called, known)),
        "import_complexity": _count(code, _IMPORTS, ["import"]),
        "error_words": _count(code, pattern(ERROR_WORD_PATTERN), _ERROR_NEEDLES),
    }


def chunk_features(chunks: DataFrame) -> DataFrame:
    """The chunk rows with 27 vector features and three semantic ones."""
    joined = chunks.withColumn("code", F.array_join("added_lines", "\n"))
    with_code = joined.withColumn("folded_code", folded(F.col("code")))
    code, folded_code, lines = F.col("code"), F.col("folded_code"), F.col("added_lines")
    columns = {
        **_size_columns(code, folded_code, lines),
        **_complexity_columns(code),
        **_flag_columns(folded_code),
        **_hygiene_columns(code),
        **_path_columns(F.col("file_path")),
        **_semantic_columns(code),
    }
    counted = with_code.select(*chunks.columns, *[c.alias(name) for name, c in columns.items()])
    total = F.greatest(F.col("num_added_lines"), F.lit(1))
    return counted.select(
        "*",
        (F.col("num_branches") + F.col("num_loops") + 1).alias("cyclomatic_estimate"),
        (F.col("comment_lines") / total).alias("comment_ratio"),
        ratio4(F.col("error_words"), total).alias("error_handling_ratio"),
    ).drop("comment_lines", "error_words")


def vector_array(names: list[str] = VECTOR_COLUMNS) -> Column:
    """The feature vector as an array of doubles, in its fixed order."""
    return F.array(*[F.col(name).cast("double") for name in names])


def vector_columns(features: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the 27 vector features as doubles, in their fixed order."""
    return features.select(*keys, *[F.col(name).cast("double").alias(name) for name in VECTOR_COLUMNS])
