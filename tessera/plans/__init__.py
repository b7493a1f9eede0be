"""Plan builders and the catalogues of registered queries."""

from tessera.plans import catalog_chat, catalog_metrics, catalog_mix, catalog_shards, catalog_text

CATALOGS = [catalog_text, catalog_mix, catalog_chat, catalog_metrics, catalog_shards]
