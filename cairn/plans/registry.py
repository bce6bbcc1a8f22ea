"""All queries over the point-cloud stand-in with their SQL."""

from cairn.plans import bundles, fields, floors, meshes, scalars, scenes, shapes, streams, volumes

QUERIES, SQL = {}, {}
for module in (fields, scalars, volumes, streams, meshes, floors, shapes, bundles, scenes):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
FLAGSHIP = QUERIES["suggested_region"]
