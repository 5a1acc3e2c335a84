"""Schemas, keys and defaults of the nineteen catalog tables, and of the documents inside them."""

from __future__ import annotations

# Columns in table order, with primary keys and column defaults.
TABLES: dict[str, str] = {
    "media_files": "id string, file_path string, sha256_prefix string, codec string, resolution_w bigint, resolution_h bigint, fps double, duration_seconds double, created_at string, gps_lat double, gps_lon double, audio_channels bigint, status string, metadata_json string",
    "transcripts": "media_id string, segments_json string, language string",
    "shot_boundaries": "media_id string, boundaries_json string, method string",
    "detections": "media_id string, frame_number bigint, detections_json string",
    "faces": "media_id string, frame_number bigint, face_index bigint, bbox_json string, embedding binary, cluster_id bigint",
    "face_clusters": "cluster_id bigint, label string, representative_embedding binary, sample_image_paths string",
    "clip_embeddings": "media_id string, frame_number bigint, embedding binary",
    "audio_events": "media_id string, timestamp_seconds double, events_json string",
    "activity_clusters": "cluster_id string, label string, description string, time_start string, time_end string, location_label string, gps_center_lat double, gps_center_lon double, clip_ids_json string, excluded boolean",
    "narratives": "narrative_id string, title string, description string, proposed_duration_seconds double, activity_cluster_ids_json string, arc_notes string, emotional_journey string, status string",
    "edit_plans": "narrative_id string, edl_json string, otio_path string, validation_json string, render_path string",
    "crop_paths": "media_id string, target_aspect string, subject_track_id bigint, smoothing_tau double, frame_index bigint, crop_x double, crop_y double",
    "captions": "media_id string, start_time double, end_time double, caption string, model_name string",
    "narrative_scripts": "narrative_id string, script_json string, created_at string",
    "uploads": "narrative_id string, youtube_video_id string, youtube_url string, uploaded_at string, privacy_status string",
    "pipeline_gates": "stage string, mode string, status string, decided_at string, decided_by string, notes string, timeout_hours double",
    "pipeline_jobs": "job_id string, stage string, job_type string, target_id string, target_label string, status string, started_at string, finished_at string, duration_seconds double, progress_pct double, error_message string, worker string, run_id string",
    "pipeline_events": "event_id bigint, event_type string, stage string, job_id string, payload_json string, created_at timestamp",
    "pipeline_runs": "run_id string, started_at string, finished_at string, config_snapshot string, current_stage string, status string, wall_clock_seconds double, budget_remaining_seconds double",
}

KEYS: dict[str, tuple[str, ...]] = {
    "media_files": ("id",),
    "transcripts": ("media_id",),
    "shot_boundaries": ("media_id", "method"),
    "detections": ("media_id", "frame_number"),
    "faces": ("media_id", "frame_number", "face_index"),
    "face_clusters": ("cluster_id",),
    "clip_embeddings": ("media_id", "frame_number"),
    "audio_events": ("media_id", "timestamp_seconds"),
    "activity_clusters": ("cluster_id",),
    "narratives": ("narrative_id",),
    "edit_plans": ("narrative_id",),
    "crop_paths": ("media_id", "target_aspect", "subject_track_id", "frame_index"),
    "captions": ("media_id", "start_time", "end_time"),
    "narrative_scripts": ("narrative_id",),
    "uploads": ("narrative_id",),
    "pipeline_gates": ("stage",),
    "pipeline_jobs": ("job_id",),
    "pipeline_events": ("event_id",),
    "pipeline_runs": ("run_id",),
}

DEFAULTS: dict[str, dict[str, object]] = {
    "media_files": {"status": "ingested"},
    "activity_clusters": {"excluded": False},
    "narratives": {"status": "proposed"},
    "uploads": {"privacy_status": "unlisted"},
    "pipeline_gates": {"mode": "auto", "status": "idle", "decided_by": "system"},
    "pipeline_jobs": {"status": "pending"},
    "pipeline_runs": {"status": "running"},
}

# Tables that reference others: column -> (table, key).
REFERENCES: dict[str, dict[str, tuple[str, str]]] = {
    **{t: {"media_id": ("media_files", "id")} for t in ("transcripts", "shot_boundaries", "detections", "faces", "clip_embeddings", "audio_events", "crop_paths", "captions")},
    **{t: {"narrative_id": ("narratives", "narrative_id")} for t in ("edit_plans", "narrative_scripts", "uploads")},
}

STAGES = ("ingest", "analyze", "classify", "narrate", "script", "edl", "source", "render", "upload")
STAGE_ALIASES = {"source_assets": "source"}

# Event types consumers know.
EVENT_TYPES = (
    "stage_started", "stage_completed", "stage_error", "job_started", "job_completed", "job_error", "job_progress",
    "gate_waiting", "gate_approved", "gate_skipped", "run_completed", "run_failed", "notification",
)

SEGMENT = "struct<start:double,end:double,text:string,speaker:string,words:array<struct<word:string,start:double,end:double,score:double>>>"
DETECTION = {"track_id": "bigint", "class": "string", "bbox_xywh": "array<double>", "confidence": "double"}

# The eight lists of an edit plan, and the fields of their items that the jobs here read.
EDL_LISTS: dict[str, dict[str, str]] = {
    "clips": {"clip_id": "string", "in_timecode": "string", "out_timecode": "string", "track": "bigint", "source_path": "string", "overlay": "string"},
    "transitions": {"type": "string", "position": "string", "duration": "double", "track": "bigint"},
    "crop_modes": {"clip_id": "string", "mode": "string", "subject_track_id": "bigint", "offset_x": "double", "offset_y": "double", "smoothing_tau": "double"},
    "titles": {"text": "string", "position": "string", "duration": "double"},
    "audio_settings": {"clip_id": "string", "level_db": "string"},
    "music": {"mood": "string", "duration": "double", "start_time": "string"},
    "voiceovers": {"text": "string", "start_time": "string", "duration": "double"},
    "broll_requests": {"description": "string", "duration": "double", "start_time": "string"},
}
