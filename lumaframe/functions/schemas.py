"""The tables of the model."""

PROJECTS = "project_id string, source_format string, width int, height int, color_mode string"
FRAMES = "project_id string, frame_index int, duration_ms int"
FRAME_TAGS = "project_id string, tag_index int, name string, from_frame int, to_frame int, direction string"
LAYERS = "project_id string, layer_index int, layer_id string, name string, visible boolean, opacity int"
CELS = "project_id string, layer_index int, frame_index int, x int, y int, w int, h int, color_space string, rgba binary"
IMPORT_ERRORS = "project_id string, source_format string, code string, message string"
VIOLATIONS = "project_id string, code string, path string, message string, ordinal int"
TABLES = {"projects": PROJECTS, "frames": FRAMES, "frame_tags": FRAME_TAGS, "layers": LAYERS, "cels": CELS}
