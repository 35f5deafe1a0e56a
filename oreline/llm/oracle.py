"""DuckDB SQL for those queries of the subpackage that SQL can express."""

SQL: dict[str, str] = {}
