"""Schemas of the catalogue's tables.

State is plain Parquet: an append-only log of feed records and snapshots derived from
it.  Timestamps are UTC; vectors are arrays of floats of unit length.
"""

from __future__ import annotations

RENDITION = "struct<bytes: bigint, width: int, height: int, type: string, filename: string>"

SCHEMAS: dict[str, str] = {
    "assets": f"id string, master_id string, filename string, kind string, live boolean, taken timestamp, added timestamp, width int, height int, bytes bigint, favorite boolean, hidden boolean, caption string, latitude double, longitude double, versions map<string, {RENDITION}>, fingerprint string, first_seen timestamp, last_seen timestamp, missing_since timestamp, zone string",
    "albums": "id string, name string, fullname string, synced timestamp",
    "album_assets": "album_id string, asset_id string",
    "cache": "asset_id string, version string, path string, bytes bigint, fetched timestamp, used timestamp, pinned boolean",
    "records": "name string, type string, deleted boolean, modified timestamp, master_ref string, json string, zone string, seq bigint",
    "people": "id string, name string, display_name string, verified boolean, kind int, modified timestamp, deleted boolean",
    "face_crops": "id string, person_id string, kind int, bytes bigint, modified timestamp, deleted boolean",
    "index_state": "asset_id string, clip_model string, face_model string, source string, indexed timestamp, faces int",
    "faces": "id bigint, asset_id string, box array<int>, det double, age int, gender int, embedding array<float>, source string, person_id string, similarity double, assigned string, cluster int",
    "person_seeds": "id string, person_id string, embedding array<float>, det double, origin string, created timestamp",
    "collections": "name string, created timestamp",
    "collection_assets": "collection string, asset_id string, position bigint, note string",
    "variants": "id bigint, asset_id string, parent bigint, path string, prompt string, method string, source_version string, width int, height int, bytes bigint, created timestamp",
    "edit_jobs": "id bigint, asset_id string, state string, prompt string, created timestamp",
    "books": "name string, title string, created timestamp",
    "book_pages": "id bigint, book string, position bigint, collection string, ids array<string>, template string, caption string",
    "clip": "asset_id string, embedding array<float>",
}
