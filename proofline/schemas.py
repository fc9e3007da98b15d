"""Explicit schemas of every table; nothing is inferred."""

IMAGES = ("image_id bigint, name string, mime string, size_bytes bigint, width_px int, height_px int, "
          "batch_id bigint, seq int")
PIXELS = "image_id bigint, w int, h int, x int, y int, r int, g int, b int, a int"
SCANLINES = ("image_id bigint, w int, h int, y int, r array<int>, g array<int>, b array<int>, a array<int>")
MANIFEST = ("id string, name string, filename string, width int, height int, description string, "
            "targetPreset string, dataUrl string, sizeBytes bigint")
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
PART = ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
