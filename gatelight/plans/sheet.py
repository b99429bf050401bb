"""The delivery sheet the registered queries are judged by: what each profile asks for, and the limits all profiles share."""

#: Profiles, zones and limits of the delivery contract.
SHEET = {
    "defaults": {
        "image": {"max_file_size_mb": 8, "min_sharpness": 45.0, "max_letterbox_fraction": 0.01, "luma_mean_range": [22, 238]},
        "video": {
            "container": "mp4", "video_codec": "h264", "pixel_format": "yuv420p", "audio_codec": "aac", "audio_channels": 2,
            "audio_sample_rate": 48000, "max_file_size_mb": 120, "max_letterbox_fraction": 0.01, "min_sharpness": 6.0,
        },
        "compliance": {
            "face_clip_tolerance": 0.995, "require_subject_present": True, "significant_face_relative_size": 0.45,
            "significant_face_frame_fraction": 0.055, "min_subject_frame_coverage": 0.70, "max_subject_absence_s": 1.5,
            "min_active_speaker_coverage": 0.80, "max_static_frames_fraction": 0.95,
        },
    },
    "profiles": [
        {"id": "hero_landscape_16x9", "ratio": "16:9", "kind": "image", "width": 1920, "height": 1080, "safe_zones": {"action": [0.04, 0.04, 0.96, 0.96]}, "min_face": 0.06},
        {"id": "social_square_1x1", "ratio": "1:1", "kind": "image", "width": 1080, "height": 1080, "safe_zones": {"action": [0.05, 0.05, 0.95, 0.95]}, "min_face": 0.08},
        {
            "id": "story_vertical_9x16", "ratio": "9:16", "kind": "image", "width": 1080, "height": 1920, "safe_zones": {"action": [0.05, 0.14, 0.95, 0.84]}, "min_face": 0.09,
            "reserved_zones": [
                {"name": "top_chrome", "rect": [0.00, 0.00, 1.00, 0.12]}, {"name": "bottom_chrome", "rect": [0.00, 0.86, 1.00, 1.00]},
                {"name": "action_rail", "rect": [0.82, 0.55, 1.00, 0.86]},
            ],
        },
        {"id": "feed_portrait_4x5", "ratio": "4:5", "kind": "image", "width": 1080, "height": 1350, "safe_zones": {"action": [0.05, 0.06, 0.95, 0.94]}, "min_face": 0.08},
        {
            "id": "reel_vertical_9x16", "ratio": "9:16", "kind": "video", "width": 1080, "height": 1920,
            "fps_range": [23.0, 61.0], "duration_range_s": [3.0, 90.0], "bitrate_kbps_range": [1500, 14000], "safe_zones": {"action": [0.05, 0.14, 0.95, 0.84]}, "min_face": 0.10,
            "reserved_zones": [
                {"name": "top_chrome", "rect": [0.00, 0.00, 1.00, 0.12]}, {"name": "bottom_chrome", "rect": [0.00, 0.86, 1.00, 1.00]},
                {"name": "action_rail", "rect": [0.82, 0.55, 1.00, 0.86]},
            ],
            "overrides": {"min_active_speaker_coverage": 0.80},
        },
        {"id": "video_still_16x9", "ratio": "16:9", "kind": "image", "width": 1920, "height": 1080, "safe_zones": {"action": [0.04, 0.04, 0.96, 0.96]}, "min_face": 0.05, "overrides": {"min_sharpness": 60.0}},
    ],
    "render_sets": {
        "image": ["hero_landscape_16x9", "social_square_1x1", "story_vertical_9x16", "feed_portrait_4x5"],
        "video": ["reel_vertical_9x16", "video_still_16x9"],
    },
}
