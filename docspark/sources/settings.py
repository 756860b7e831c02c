"""Connection settings of the record store."""

from __future__ import annotations

from collections.abc import Mapping


def jdbc_options(given: Mapping[str, str], stored: Mapping[str, str] | None = None) -> dict[str, str]:
    """JDBC options: ``given`` before ``stored``; user and password must be there, the port must be a number."""
    at = lambda key, default=None: given.get(key) or (stored or {}).get(key) or default
    user, password = at("MYSQL_USER"), at("MYSQL_PASSWORD")
    if not user or not password:
        raise ValueError("MYSQL_USER and MYSQL_PASSWORD must be set")
    port = at("MYSQL_PORT", "3306")
    if not port.isdigit():
        raise ValueError("MYSQL_PORT must be a number")
    return {"url": f"jdbc:mysql://{at('MYSQL_HOST', 'localhost')}:{port}/{at('MYSQL_DATABASE', 'documents')}", "user": user, "password": password, "connectTimeout": "10000"}
