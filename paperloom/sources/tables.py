"""The tables of a data folder and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the project's own tables; a table that is not named here is read with the schema of its files.
SCHEMAS = {
    "users": "id long, username string, is_admin boolean, created_at timestamp_ntz",
    "images": "id long, user_id long, image_name string, image_path string, extracted_text string, original_ocr_text string, cleaned_text string, category string, has_visual_objects boolean, visual_metadata string, entities_json string, file_size_bytes long, image_width int, image_height int, file_format string, blip_caption string, qr_payload string, stego_payload string, ocr_boxes_json string, created_at timestamp_ntz, file_modified_at string, exif_created_at string, primary_date string, sha256_hash string, phash string, is_duplicate boolean, canonical_image_id long, duplicate_similarity double, duplicate_match_type string, indexing_status string, is_demo boolean, is_quarantined boolean, ocr_lang string",
    "image_relationships": "id long, source_image_id long, target_image_id long, relationship_type string, confidence_score double, evidence string, created_at timestamp_ntz",
    "visual_regions": "id long, image_id long, image_name string, region_source string, location_desc string, bbox_json string, norm_bbox_json string, embedding_blob binary, created_at timestamp_ntz",
    "metadata": "image_id string, filename string, category string, expected_title string, expected_text string, keywords string",
    "incoming_uploads": "upload_id long, batch_id long, user_id long, image_name string, file_format string, file_size_bytes long, sha256_hash string, phash string, received_at timestamp_ntz",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of ``folder``, a parquet file or a folder of part files; with a known schema no file is opened to plan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")
