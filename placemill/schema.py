"""Schemas of the snapshot files. Reads never infer; bad lines land in ``_corrupt``."""

from __future__ import annotations

OSM_ELEMENT = (
    "search_id bigint, ord bigint, type string, id bigint, lat double, lon double, "
    "center struct<lat:double,lon:double>, tags map<string,string>, _corrupt string"
)
ENTITY_ROW = (
    "search_id bigint, ord bigint, item string, itemLabel string, itemDescription string, coord string, "
    "typeLabel string, website string, commons string, _corrupt string"
)
GAZETTEER_ROW = (
    "search_id bigint, ord bigint, osm_type string, osm_id bigint, lat string, lon string, name string, "
    "display_name string, category string, type string, extratags map<string,string>, "
    "address map<string,string>, _corrupt string"
)
GOOGLE_ROW = (
    "search_id bigint, ord bigint, place_id string, name string, lat double, lon double, types array<string>, "
    "rating double, user_ratings_total bigint, formatted_address string, _corrupt string"
)
GOOGLE_DETAILS = (
    "place_id string, name string, url string, website string, formatted_address string, formatted_phone_number string, "
    "international_phone_number string, rating double, user_ratings_total bigint, overview string, "
    "weekday_text array<string>, types array<string>, "
    "photos array<struct<photo_reference:string,width:int,height:int,html_attributions:array<string>>>, _corrupt string"
)
PLACE = (
    "search_id bigint, ord bigint, id string, osm_type string, osm_id bigint, name string, lat double, lon double, "
    "tags map<string,string>, category string, category_label string, source string"
)
CORPUS = (
    "ord bigint, city string, country string, script string, keyword string, "
    "place struct<id:string,osm_type:string,osm_id:bigint,name:string,lat:double,lon:double,"
    "tags:map<string,string>,category:string,category_label:string,source:string>, _corrupt string"
)
ENTITY = (
    "entity_id string, descriptions map<string,string>, sitelinks map<string,string>, labels map<string,string>, "
    "claims map<string,array<struct<datatype:string,value:string>>>, _corrupt string"
)
PHOTO_COLUMNS = (
    "place_id string, ord bigint, url string, download_url string, thumb_url string, width int, height int, "
    "source string, title string, credit string, license string, source_page string, lat double, lon double"
)
COMPLETION = "batch_id bigint, pos bigint, raw string"
PAGE = "page_id bigint, url string, html string"
