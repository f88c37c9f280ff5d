"""Record layouts of manifests, preference pairs, clips and logs; every column is nullable."""

from __future__ import annotations

# The fields of a sample, in order.
SAMPLE_DDL = (
    "sample_id string, source string, template string, camera_motion string, video_path string, hdf5_path string, "
    "rgb_frames string, depth_path string, id_path string, poses_path string, intrinsics_path string, prompt_path string, "
    "num_frames int, fps double, width int, height int, has_moving_camera boolean, has_depth boolean, has_id_mask boolean, "
    "has_object_state boolean, quality_flags array<string>"
)
SAMPLE_FIELDS = [part.split()[0] for part in SAMPLE_DDL.split(", ")]
#: Optional columns that some inputs carry too.
SAMPLE_EXTRAS = ["candidate_video_path", "image_path", "prefix_path"]
#: What a missing key of a sample becomes; all other missing keys become null.
SAMPLE_DEFAULTS = {"has_moving_camera": False, "has_depth": False, "has_id_mask": False, "has_object_state": False}
# The known sources and the path fields that validation looks up.
SOURCES = ["phyinone", "movingcam_synthetic"]
CHECKED_PATHS = ["video_path", "hdf5_path", "poses_path", "intrinsics_path", "prompt_path"]

# The layout of a reward record.
COMPONENT = "struct<score:double,status:string>"
REWARD_DDL = (
    "sample_id string, reward_total double, reward_raw double, weights map<string,double>, "
    f"components struct<bg:{COMPONENT},cam:{COMPONENT},fg:{COMPONENT},phys:{COMPONENT},reobs:{COMPONENT},quality:{COMPONENT},"
    "freeze:struct<penalty:double,reasons:array<string>>>, source string, template string, camera_motion string"
)
# The fields that a pair must have.
PAIR_FIELDS = ["pair_id", "condition", "winner", "loser", "pair_type", "margin", "quality_flags"]

# Columns of clip metadata, all text, and those that clips with actions add.
CLIP_COLUMNS = [
    "clip_path", "prompt", "trajectory_name", "camera_id", "physics_bucket", "source_zip", "source_height", "source_width",
    "raw_frame_count", "clip_frames", "target_fps", "sampling_mode", "window_index", "window_start_frame", "window_end_frame",
    "control_type",
]
ACTION_COLUMNS = ["action_source", "action_channels", "action_scale_forward", "action_scale_strafe", "action_scale_yaw", "action_scale_pitch"]
# Columns of metric tables and logs, and of cleanup candidates.
METRIC_COLUMNS = ["clip_name", "clip_path", "prompt", "reference_videopath", "candidate_videopath", "psnr", "ssim", "lpips"]
PHYSICS_METRICS = ["compare_frame_count", "mse_mean", "spatiotemporal_iou_mean", "spatial_iou", "weighted_spatial_iou", "physics_iq_style_score"]
METRIC_LOG_DDL = "time double, step bigint, payload string"
CLEANUP_DDL = "path string, size_gb string, type string, reason string, risk string, action string"
