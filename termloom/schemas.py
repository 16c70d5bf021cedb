"""Explicit schemas of the tables and of the captured documents."""

from __future__ import annotations

LATE_POLICY = (
    "struct<raw_text:string,accepts_late:boolean,default_penalty_per_day:double,max_late_days:int,exceptions:string>"
)
CATEGORIES = "array<struct<name:string,weight:double,description:string>>"
SCALE = "map<string,array<double>>"

COURSES = f"""student_id bigint, course_id string, code string, name string, instructor string,
  d2l_course_id string, d2l_url string, semester string, external_platform string, external_platform_url string,
  textbook string, syllabus_raw_text string, syllabus_parsed struct<late_policy:{LATE_POLICY},review_flags:array<string>>,
  grading_scale {SCALE}, grade_categories {CATEGORIES}, late_policy_global string, current_grade_pct double,
  current_letter_grade string, last_scraped_d2l timestamp, last_scraped_external timestamp,
  last_syllabus_parse timestamp"""

ASSIGNMENTS = f"""student_id bigint, course_id string, id string, title string, description string, type string,
  source_platform string, external_url string, available_date timestamp, due_date timestamp, close_date timestamp,
  grade_category string, grade_weight_pct double, points_possible double, points_earned double, grade_pct double,
  status string, is_submitted boolean, submitted_at timestamp, is_late boolean, days_late int,
  late_policy {LATE_POLICY}, estimated_minutes int, is_multi_day boolean, raw map<string,string>,
  last_scraped timestamp"""

LOG = """log_id bigint, created_at timestamp, student_id bigint, course_id string, assignment_id string,
  stage string, source_url string, artifact_ref string, text_preview string, detail string"""

AGENDA = """student_id bigint, assignment_id string, agenda_date date, planned_minutes int, priority_score double,
  notes string"""

FACT_EVIDENCE = "student_id bigint, course_id string, assignment_id string, artifact_id string, quote string"
FACT_NOTES = "student_id bigint, course_id string, assignment_id string, note string"
FACT_ARTIFACTS = "student_id bigint, course_id string, assignment_id string, artifact_id string"

TOPIC = (
    "struct<title:string,url:string,module_title:string,content_type:string,launch_url:string,extracted_text:string>"
)
LMS_COURSE = f"""struct<course_id:string,code:string,name:string,offering_code:string,semester:string,
  end_date_text:string,home_url:string,
  final_calculated_grade:struct<weight_achieved_text:string,grade_text:string>,
  tool_links:array<struct<name:string,url:string>>,
  upcoming_events:array<struct<title:string,due_text:string,details_url:string>>,
  announcements:array<struct<title:string,url:string,posted_at_text:string,
    items:array<struct<title:string,url:string>>>>,
  grade_rows:array<struct<title:string,is_category:boolean,category_title:string,points_text:string,
    weight_achieved_text:string,grade_text:string>>,
  syllabus_topics:array<{TOPIC}>,external_tools:array<{TOPIC}>,content_outline_topics:array<{TOPIC}>>"""
LMS_SNAPSHOT = f"student_id bigint, fetched_at timestamp, source_url string, courses array<{LMS_COURSE}>"

PUBLISHER_SNAPSHOT = """student_id bigint, fetched_at timestamp,
  courses array<struct<course_id:string,source_platform:string,launch_url:string,title:string>>,
  assignments array<struct<id:string,course_id:string,source_platform:string,title:string,type:string,status:string,
    external_url:string,description:string,due_at:timestamp,due_text:string,points_earned:double,
    points_possible:double,grade_pct:double,estimated_minutes:int,raw_source:map<string,string>>>"""

CRAWL_MANIFEST = """student_id bigint, fetched_at timestamp, artifacts_dir string,
  courses array<struct<course_id:string,code:string,name:string,artifact_count:int>>,
  artifacts array<struct<id:string,course_id:string,course_code:string,source_platform:string,artifact_type:string,
    page_kind:string,title:string,url:string,parent_url:string,fetched_at:timestamp,html_path:string,
    text_path:string,screenshot_path:string,metadata:map<string,string>>>"""

SPAN = "struct<artifact_id:string,quote:string>"
FACT_FIELDS = f"""title:string,assignment_type:string,source_platform:string,grade_category:string,due_at:string,
  due_on:string,due_text:string,weight_pct:double,points_possible:double,points_earned:double,grade_pct:double,
  submitted:boolean,graded:boolean,optional:boolean,extra_credit:boolean,counts_toward_grade:boolean,status:string,
  rationale:string,evidence_spans:array<{SPAN}>,evidence_artifact_ids:array<string>,notes:array<string>"""
FACTS_RESPONSE = f"struct<assignments:array<struct<{FACT_FIELDS}>>>"
RULES_RESPONSE = """struct<course_code:string,course_name:string,
  grade_categories:array<struct<name:string,weight:double,notes:string>>,grading_scale:map<string,array<double>>,
  late_policy:struct<raw_text:string,accepts_late:boolean,default_penalty_per_day:double,max_late_days:int>,
  notes:array<string>>"""

EXTRACTION = f"""student_id bigint, extracted_at timestamp, source_snapshot_path string, source_artifacts_dir string,
  courses array<struct<course_id:string,course_code:string,course_name:string,
    assignments:array<struct<{FACT_FIELDS.replace("source_platform:string", "source_platforms:array<string>")}>>,
    grade_categories:array<struct<name:string,weight:double,notes:string>>,
    grading_scale:map<string,array<double>>,
    late_policy:struct<raw_text:string,accepts_late:boolean,default_penalty_per_day:double,max_late_days:int>,
    current_grade_pct:double,calculation_notes:array<string>,artifact_count:int,
    provenance_events:array<struct<stage:string,assignment_id:string,source_url:string,artifact_ref:string,
      text_preview:string,detail:string>>>>"""

PARSED_SYLLABUS = """struct<course_name:string,course_code:string,instructor:string,semester:string,
  grade_categories:array<struct<name:string,weight:double,description:string,drop_lowest:int,total_count:int>>,
  grading_scale:map<string,array<double>>,
  late_policy:struct<default_penalty_per_day:double,max_late_days:int,accepts_late:boolean,exceptions:string,raw_text:string>,
  exams:array<struct<name:string,date:string,weight_pct:double,topics:string,location:string>>,
  important_dates:array<struct<date:string,event:string>>,
  external_tools:array<struct<name:string,purpose:string,textbook:string>>,
  office_hours:string,attendance_policy:string,extra_credit:string>"""
