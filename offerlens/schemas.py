"""Schemas of the domain's files, declared and never inferred."""

WINDOW = "struct<dow:int,start:string,end:string>"
ITEM = "struct<category:string,label:string,price_usd:double,discount_pct:double,amount_off_usd:double>"
SOURCE = "struct<kind:string,url:string,quote:string,note:string,photo_id:string,submitted:string,outlet:string,published:string>"
DEAL = (
    f"struct<type:string,windows:array<{WINDOW}>,items:array<{ITEM}>,fine_print:string,confidence:string,last_verified_at:date,verified_by:string,items_source:string,source:{SOURCE}>"
)
LICENCE = (
    "`LID` string, `License Number` string, `License Type` string, `Status` string, `Premises` string, `Licensee` string, `Premises Address` string, `County` string, "
    "`Municipality` string, `Expiration Date` string"
)
ZONES = (
    "origin struct<name:string,lat:double,lng:double>, radius_miles double, counties_in_scope array<string>, zones array<struct<id:string,name:string,anchor:string,"
    "municipalities:array<array<string>>,zips:array<string>,opt_in:boolean,default_off:boolean,default_for_origin:boolean>>"
)
ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
VENUE = (
    "id string, lid string, slug string, name string, address string, zone_id string, website string, plcb_name string, license_type string, lat double, lng double, "
    f"geo_precision string, photo struct<file:string,attribution:string>, also_lids array<string>, deals array<{DEAL}>"
)
CRAWL = (
    "lid string, name string, osm_name string, address string, zone_id string, website string, crawled_at date, pages array<struct<url:string,result:string>>, "
    "hits array<struct<url:string,quote:string>>"
)
PAGE = "url string, html string, status int, content_type string"
PROPOSAL = "id string, items array<struct<category:string,label:string,price_usd:double,discount_pct:double,evidence:string>>"
PHOTO_PROPOSAL = (
    "is_menu boolean, rejection_reason string, concerns array<string>, venue_name_on_menu string, transcript string, deals array<struct<type:string,windows:array<struct<dow:int,start:string,"
    "end:string>>,items:array<struct<category:string,label:string,price_usd:double,discount_pct:double,quote:string>>,fine_print:string>>"
)
SUBMISSION = (
    "id string, lid string, venue_name string, r2_key string, bytes bigint, content_type string, note string, submitted_at string, ip_hash string, status string, extracted string, "
    "extract_error string, extracted_at string, reviewed_at string, review_note string"
)
