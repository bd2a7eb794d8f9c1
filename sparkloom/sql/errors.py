"""The error contract: numeric codes in bands, each with a SQLSTATE, told in the message."""

from __future__ import annotations

from pyspark.errors import PySparkException

#: Stands before the number in messages.
PREFIX = "ENG"

#: Name -> (number, SQLSTATE). Codes of nodes, queues and quorums are left out: nothing here can raise them.
CODES = {
    "TABLE_NOT_FOUND": (1000, "42P01"),
    "COLUMN_NOT_FOUND": (1001, "42703"),
    "TYPE_MISMATCH": (1002, "42804"),
    "SQL_SYNTAX_ERROR": (1003, "42601"),
    "FEATURE_NOT_SUPPORTED": (1004, "0A000"),
    "TABLE_ALREADY_EXISTS": (1005, "42P07"),
    "COLUMN_ALREADY_EXISTS": (1006, "42701"),
    "WRITE_CONFLICT": (2001, "40001"),
    "ENGINE_ERROR": (2002, "XX000"),
    "CATALOG_ACCESS_ERROR": (4003, "XX000"),
}

#: Spark's error conditions, by their beginning.
_CONDITIONS = (
    ("TABLE_OR_VIEW_NOT_FOUND", "TABLE_NOT_FOUND"),
    ("UNRESOLVED_COLUMN", "COLUMN_NOT_FOUND"),
    ("UNRESOLVED_USING_COLUMN", "COLUMN_NOT_FOUND"),
    ("DATATYPE_MISMATCH", "TYPE_MISMATCH"),
    ("CAST_INVALID_INPUT", "TYPE_MISMATCH"),
    ("CAST_OVERFLOW", "TYPE_MISMATCH"),
    ("CANNOT_PARSE", "TYPE_MISMATCH"),
    ("NUMERIC_VALUE_OUT_OF_RANGE", "TYPE_MISMATCH"),
    ("INVALID_PARAMETER_VALUE", "TYPE_MISMATCH"),
    ("INVALID_INLINE_TABLE.FAILED_SQL_EXPRESSION_EVALUATION", "TYPE_MISMATCH"),
    ("PARSE_", "SQL_SYNTAX_ERROR"),
    ("UNRESOLVED_ROUTINE", "FEATURE_NOT_SUPPORTED"),
    ("UNSUPPORTED_", "FEATURE_NOT_SUPPORTED"),
)


class EngineError(Exception):
    """An error of the engine with its code name, number and SQLSTATE."""

    def __init__(self, name: str, message: str, detail: str = "", hint: str = "", sqlstate: str = ""):
        self.name = name
        self.number, state = CODES[name]
        self.sqlstate = sqlstate or state
        self.detail, self.hint = detail, hint
        self.message = f"[{PREFIX}-{self.number}] {message}"
        super().__init__(self.message)


def not_supported(what: str) -> EngineError:
    return EngineError("FEATURE_NOT_SUPPORTED", f"{what} is not supported")


def from_spark(error: PySparkException) -> EngineError:
    """Spark's error as one of the contract's."""
    condition = error.getCondition() or ""
    name = next((n for start, n in _CONDITIONS if condition.startswith(start)), "ENGINE_ERROR")
    return EngineError(name, str(error).split("\n\nJVM stacktrace")[0].split(" SQLSTATE:")[0].strip()[:600])
