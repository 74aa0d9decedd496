"""Store tables and documents as Spark schemas (DDL)."""

from __future__ import annotations

TABLES = {
    "frames": "run_id bigint, frame_idx bigint, timestamp_ms bigint, image_path string, is_keyframe boolean, delta_score double",
    "detections": "run_id bigint, detection_id bigint, frame_idx bigint, track_id bigint, class_name string, "
    "x1 double, y1 double, x2 double, y2 double, confidence double, mean_depth double, mask_rle string",
    "depth_frames": "run_id bigint, frame_idx bigint, depth_path string",
    "audio_segments": "run_id bigint, segment_id bigint, start_ms bigint, end_ms bigint, text string, "
    "no_speech_prob double, avg_logprob double",
    "run_stages": "run_id bigint, stage_name string, finished_at timestamp, elapsed_s double, n_units bigint",
    "ethogram_labels": "run_id bigint, label_id bigint, frame_idx bigint, behavior string, confidence double, "
    "note string, profile_name string",
    "frame_captions": "run_id bigint, frame_idx bigint, caption string, change_line string, walker_model string, "
    "escalated boolean, verifier_caption string, verifier_agrees boolean, verifier_model string, "
    "created_at timestamp, verified_at timestamp, prompt string",
    "run_meta": "run_id bigint, key string, value string",
}

KEYS = {
    "frames": ["run_id", "frame_idx"],
    "detections": ["run_id", "detection_id"],
    "depth_frames": ["run_id", "frame_idx"],
    "audio_segments": ["run_id", "segment_id"],
    "run_stages": ["run_id", "stage_name"],
    "ethogram_labels": ["run_id", "label_id"],
    "frame_captions": ["run_id", "frame_idx"],
    "run_meta": ["run_id", "key"],
}

TRANSCRIPT = (
    "run_id bigint, transcription array<struct<offsets:struct<from:bigint,to:bigint>,text:string>>, "
    "segments array<struct<start:double,end:double,text:string>>, _corrupt_record string"
)
CHUNKS = (
    "run_id bigint, chunk_id bigint, frame_indices array<bigint>, per_frame_lines map<string,string>, "
    "summary string, raw_response string"
)
TIMINGS = "run_id bigint, stage string, elapsed_s double, n_units bigint, video string"
