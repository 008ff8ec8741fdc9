"""Fixed schemas of the catalog tables and documents."""

from __future__ import annotations

GPS = "struct<lat:double,lon:double,altitude_m:double>"
SETTINGS = (
    "struct<min_duration:double,max_duration:double,target_duration:double,analysis_fps:double,"
    "sensitivity:double,include_static:boolean>"
)
MEDIA_INFO = (
    "struct<duration_sec:double,fps:double,width:int,height:int,codec:string,pix_fmt:string,bit_depth:int,"
    f"color_transfer:string,has_audio:boolean,creation_time:string,location:{GPS},make:string,model:string,"
    "tags:map<string,string>,telemetry_stream:int>"
)
SPRITE = "struct<interval:double,tile_width:int,tile_height:int,columns:int,rows:int,count:int>"
POI = (
    "struct<name:string,name_en:string,type:string,distance_m:bigint,bearing_deg:double,"
    "in_camera_sector:boolean,wikidata_id:string>"
)
GEO = (
    "struct<source:string,lat:double,lon:double,altitude_m:double,city:string,region:string,country:string,"
    "country_code:string,display_name:string,local_name:string,manual_text:string,camera_heading_deg:double,"
    f"poi_candidates:array<{POI}>>"
)
TECH = (
    "struct<duration_sec:double,source_duration_sec:double,fps:double,output_fps:double,width:int,height:int,"
    "resolution_label:string,codec:string,bit_depth:int,color_transfer:string,has_audio:boolean,shot_type:string,"
    "motion_type:string,movement:array<string>,time_of_day:string,season:string,captured_at:timestamp,"
    "capture_date:string,altitude_m:double,drone_model:string>"
)
METADATA = (
    "struct<title:string,description:string,keywords:array<string>,subject:string,place_confidence:string,"
    "adobe_category:int,shutterstock_categories:array<string>,envato_category:string,"
    "recognizable_buildings:boolean,editorial_suggested:boolean,editorial_reason:string>"
)

CATALOG = {
    "projects": f"id string, name string, created_at timestamp, status string, analysis_settings {SETTINGS}, manifest_path string",
    "videos": (
        "id string, project_id string, upload_id string, original_filename string, stored_path string, "
        "size_bytes bigint, duration_sec double, fps double, width int, height int, codec string, has_proxy boolean, "
        f"sprite_meta {SPRITE}, status string, progress double, error string, created_at timestamp, "
        f"media_info {MEDIA_INFO}, manual_location string, reviewed boolean, fingerprint string, "
        "content_hash string, duplicate_of_id string"
    ),
    "segments": (
        "id string, video_id string, start_sec double, end_sec double, motion_type string, score double, "
        "reasons array<string>, origin string, accepted boolean, edited boolean"
    ),
    "export_jobs": (
        "id string, project_id string, manifest_path string, created_at timestamp, build_status string, "
        "build_error string, archive_dir string, archive_zip string, archive_hash string"
    ),
    "export_clips": (
        "id string, job_id string, video_id string, segment_id string, ordinal int, start_sec double, end_sec double, "
        "start_frame bigint, end_frame bigint, motion_type string, status string, progress double, failed_step string, "
        "error string, excluded boolean, approved boolean, "
        "frames array<struct<index:int,time_sec:double,sharpness:double,url:string>>, "
        f"geo {GEO}, tech {TECH}, metadata {METADATA}, editorial boolean, user_hint string, poi_override string, "
        "step_hashes map<string,string>, cut_path string, output_size_bytes bigint, filename string, "
        "updated_at timestamp"
    ),
    "geo_cache": "key string, value variant, fetched_at timestamp",
    "app_settings": "key string, value string",
}
#: Tables that grow with the footage are laid out by the key their readers filter on.
#: What is replaced or removed as a whole in a stored catalog; the other tables are replaced altogether.
UNITS = {
    "projects": ("id",), "videos": ("project_id",), "segments": ("video_id",), "export_jobs": ("project_id",),
    "export_clips": ("job_id",),
}

FRAME_FIELDS = [
    "t", "dx", "dy", "div", "rot", "px", "py", "fit", "coherence", "magVar", "sharpness", "brightness", "overexposed",
]
FEATURE_DOCUMENT = (
    "analysisFps double, width double, height double, "
    f"features array<struct<{','.join(f + ':double' for f in FRAME_FIELDS)}>>, _corrupt_record string"
)
ANSWER_LOG = (
    "model string, promptVersion string, attempt int, durationMs bigint, "
    "response struct<message:struct<content:string>>, errors array<string>"
)
PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,profile:string,width:int,height:int,"
    "pix_fmt:string,bits_per_raw_sample:string,color_transfer:string,avg_frame_rate:string,r_frame_rate:string,"
    "duration:string,codec_tag_string:string,index:int,tags:map<string,string>,"
    "side_data_list:array<struct<rotation:double>>>>,format:struct<duration:string,tags:map<string,string>>>"
)
