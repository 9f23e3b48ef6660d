"""sitelens: site audits (blocks, layouts, links, domains, media ids) as
Spark DataFrame jobs over tables of fetched pages and their url sources."""

from .config import DEFAULT, AuditConfig, IndexFamily

__all__ = ["AuditConfig", "IndexFamily", "DEFAULT"]
