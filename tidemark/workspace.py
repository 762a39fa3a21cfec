"""Tenant scope: every table seen through one tenant, or all of them for admins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Workspace:
    """Named tables restricted to a tenant.

    The restriction is a plain filter on ``tenant_id``, so it reaches the Parquet
    scan of every table. ``Workspace.admin`` reads across tenants.
    """

    def __init__(self, tables: Mapping[str, DataFrame], tenant: str | None):
        if tenant is not None and not tenant.strip():
            raise ValueError("tenant must not be empty")
        self.tenant = tenant
        self._tables = dict(tables)

    @classmethod
    def admin(cls, tables: Mapping[str, DataFrame]) -> Workspace:
        return cls(tables, None)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise KeyError(f"unknown table: {name}")
        df = self._tables[name]
        if self.tenant is None:
            return df
        if "tenant_id" not in df.columns:
            raise PermissionError(f"table {name} has no tenant and is for admins only")
        return df.where(F.col("tenant_id") == self.tenant)

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def names(self) -> list[str]:
        return sorted(self._tables)

    def sql(self, query: str) -> DataFrame:
        """SQL in which ``{name}`` stands for the scoped table ``name``.

        Tables are passed as arguments, so views of the session cannot leak in
        under these names.
        """
        spark = next(iter(self._tables.values())).sparkSession
        used = {n: self.table(n) for n in self._tables if "{" + n + "}" in query}
        return spark.sql(query, **used)
