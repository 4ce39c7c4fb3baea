"""Record types as Spark schemas (DDL). All times are DOUBLE milliseconds."""

SESSIONS = (
    "identifier STRING, team STRING, study STRING, studyId STRING, roomId STRING, participant STRING, userId ARRAY<STRING>, "
    "screenTrackStartOffset INT, fullSessionDurationMs DOUBLE, screenTrackDurationMs DOUBLE, "
    "data STRUCT<fullSession: STRING, screenTrack: STRING, transcript: STRING, normalizedScreenTrack: STRING>"
)
EVENT = (
    "type STRING, source STRING, time_start DOUBLE, time_end DOUBLE, description STRING, confidence DOUBLE, interaction_target STRING, "
    "cursor_position STRUCT<x: DOUBLE, y: DOUBLE>, page_title STRING, page_location STRING, viewport_width INT, viewport_height INT, "
    "frame_description STRING, transcript_id STRING, study_id STRING, task_id STRING"
)
RUN = (
    "session STRING, timestamp STRING, video_duration_ms DOUBLE, "
    "segments ARRAY<STRUCT<index: INT, start_ms: DOUBLE, end_ms: DOUBLE, event_count: INT, input_tokens: BIGINT, output_tokens: BIGINT>>, "
    "total_input_tokens BIGINT, total_output_tokens BIGINT"
)
FRAME_DIFF = "session LONG, seq LONG, ts DOUBLE, magnitude DOUBLE, bbox STRUCT<x: INT, y: INT, w: INT, h: INT>, bbox_area_ratio DOUBLE"
TRAJECTORY = "session LONG, seq LONG, ts DOUBLE, x DOUBLE, y DOUBLE, confidence DOUBLE, template_id STRING, detected BOOLEAN"
FLOW_WINDOW = "session LONG, seq LONG, start DOUBLE, end DOUBLE, magnitude DOUBLE, direction STRING, uniformity DOUBLE, divergence DOUBLE"
UTTERANCE = "session LONG, seq LONG, start DOUBLE, end DOUBLE, text STRING, label STRING"
