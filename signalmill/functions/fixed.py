"""Words, patterns, thresholds and ranks that results depend on. Data only; every list is in its natural order."""

from __future__ import annotations


def _words(text: str) -> tuple[str, ...]:
    return tuple(" ".join(w.split()) for w in text.split(","))


METHODS = _words("GET, POST, PUT, PATCH, DELETE, OPTIONS, HEAD")
METHOD = "GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD"
API_IN_TEXT = rf"\b({METHOD})\s+(/[A-Za-z0-9_\-/{{}}/]+)"
ENDPOINT_IN_TEXT = r"/(?:api|v\d+)/[A-Za-z0-9_\-/{}/]+"
TABLE_IN_TEXT = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\((.*?)\)"
API_TITLE = rf"^({METHOD})\s+(/\S+)$"
API_SIGNATURE_LINE = rf"Signature:\s*({METHOD})\s+(/\S+)"
API_TITLE_STRICT = rf"^({METHOD})\s+/[A-Za-z0-9_\-/{{}}/]+$"
ENDPOINT_TITLE = r"^/[A-Za-z0-9_\-/{}/]+$"
CONTRACT = rf"^({METHOD})\s+/[a-z0-9_\-{{}}/]+$"
KEEP_API_STRICT = rf"^({METHOD})\s+/(?:[A-Za-z0-9_\-{{}}]+(?:/[A-Za-z0-9_\-{{}}]+)*)$"
KEEP_API_LOOSE = r"^/(?:api|v\d+)/(?:[A-Za-z0-9_\-{}]+(?:/[A-Za-z0-9_\-{}]+)*)$"
API_TASK = r"^(Implement|Verify)\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD|UPDATE)\s+(/\S+?)(\s+behavior)?$"
DB_COLUMN = r"([a-zA-Z_]+)\s*:\s*([A-Za-z0-9()]+)"
DB_CONSTRAINT = r"PRIMARY KEY|FOREIGN KEY|NOT NULL|UNIQUE"
VERIFY_PREFIX = r"^(verify|test|testing)\s+"
BEHAVIOR_SUFFIX = r"\s+behavior$"
PLACEHOLDER_BLOCK = r"\{[^}]+\}"
ID_TOKEN = r"\b(id|uuid|guid)\b"
VERSION_SEGMENT = r"/v\d+"
ENDPOINT_IN_TITLE = r"(/[A-Za-z0-9_\-/{}/]+)"
PARAMETER_SEGMENT = r"^(\{[^/]+\}|:[^/]+|<[^/]+>|\*)$"
JUNK = r"^(.{0,2}|test|demo|example|asdf|qwerty|lorem|null|undefined)$"
GENERIC_HEADING = r"^(overview|introduction|summary|general|misc|other|etc)\s*$"
LONE_VERB = r"^(implement|create|build|update|delete|fix|add|design|setup)\s*$"
BLACKLIST = r"\b(test|testing|todo|fixme|hack|tmp|temporary|dummy|sample)\b"
WINDOW_VERB = r"^(implement|build|create|add|design|update|delete|integrate|setup|configure)\b"
DUE_DATE = r"^\d{4}-\d{2}-\d{2}$"

#: Method hints in the order in which they are tried.
METHOD_HINTS = (
    ("POST", _words("create, add, new, register, signup, submit, import, upload, tao, tạo, them, thêm, dang ky, đăng ký, gui, gửi")),
    ("GET", _words("get, list, fetch, read, view, detail, search, xem, lay, lấy, danh sach, danh sách, tra cuu, tra cứu, tim, tìm")),
    ("PUT", _words("update, edit, modify")),
    ("PATCH", _words("change, patch")),
    ("PUT", _words("cap nhat, cập nhật, chinh sua, chỉnh sửa, sua, sửa")),
    ("PATCH", _words("doi, đổi")),
    ("DELETE", _words("delete, remove, destroy, xoa, xóa, go, gỡ")),
)

TASK_VERBS = _words(
    """implement, build, create, add, design, update, delete, integrate, setup, configure, develop, refactor, optimize, migrate, deploy,
    document, test, verify, fix, improve, analyze, review, monitor, validate, support, maintain, prepare, define, specify, plan, estimate,
    breakdown, groom, sync, align, release, harden, secure, profile, benchmark,
    xay dung, xây dựng, tao, tạo, thiet ke, thiết kế, trien khai, triển khai, cap nhat, cập nhật, xoa, xóa, tich hop, tích hợp, cau hinh,
    cấu hình, phat trien, phát triển, toi uu, tối ưu, tai cau truc, tái cấu trúc, chuan bi, chuẩn bị, lap ke hoach, lập kế hoạch, uoc luong,
    ước lượng, kiem thu, kiểm thử, xac minh, xác minh, phan tich, phân tích, danh gia, đánh giá, giam sat, giám sát, bao tri, bảo trì,
    ho tro, hỗ trợ, ghi tai lieu, ghi tài liệu, dong bo, đồng bộ, canh chinh, căn chỉnh, phat hanh, phát hành, bao mat, bảo mật,
    viet, viết, write, author, draft, investigate, research, spike, proof, poc"""
)
FEATURE_WORDS = _words(
    """feature, module, capability, functional, scope, workflow, flow, sequence, process, journey, component, data model, schema, spec,
    specification, requirement, requirements, design, architecture, api, endpoint, ui, screen, page, form, chuc nang, chức năng, tinh nang,
    tính năng, kha nang, khả năng, dac ta, đặc tả, yeu cau, yêu cầu, thiet ke, thiết kế, luong, luồng, quy trinh, quy trình, trinh tu,
    trình tự, man hinh, màn hình, giao dien, giao diện, bieu mau, biểu mẫu"""
)
CONSTRAINTS = _words(
    """NOT NULL, PRIMARY KEY, FOREIGN KEY, UNIQUE, AUTO INCREMENT, DEFAULT, CHECK, INDEX, REFERENCES, KHOA CHINH, KHÓA CHÍNH, KHOA NGOAI,
    KHÓA NGOẠI, KHONG RONG, KHÔNG RỖNG, DUY NHAT, DUY NHẤT"""
)
VOCABULARY = _words(
    """ai, api, db, ui, ux, sql, http, https, id, jwt, grpc, rest, ci, cd, ml, srs, sprint, backlog, ton dong, tồn đọng, sequence, tuan tu,
    tuần tự, activity, hoat dong, hoạt động, diagram, so do, sơ đồ, workflow, quy trinh, quy trình, service, dich vu, dịch vụ, component,
    thanh phan, thành phần, module, phan he, phân hệ, system, he thong, hệ thống, kien truc, kiến trúc, user, nguoi dung, người dùng,
    usecase, use case, truong hop su dung, trường hợp sử dụng, user story, cau chuyen nguoi dung, câu chuyện người dùng, story, cau chuyen,
    câu chuyện, epic, epic lon, feature, tinh nang, tính năng, requirement, yeu cau, yêu cầu, spec, specification, dac ta, đặc tả, business,
    nghiep vu, nghiệp vụ, solution, giai phap, giải pháp, scope, pham vi, phạm vi, task, cong viec, công việc, subtask, cong viec con,
    công việc con, plan, ke hoach, kế hoạch, planning, lap ke hoach, lập kế hoạch, roadmap, lo trinh, lộ trình, milestone, cot moc, cột mốc,
    timeline, dong thoi gian, dòng thời gian, phase, giai doan, giai đoạn, iteration, vong lap, vòng lặp, sprint planning, lap ke hoach sprint,
    lập kế hoạch sprint, backlog item, hang muc backlog, hạng mục backlog, schema, luoc do, lược đồ, migration, di chuyen du lieu,
    di chuyển dữ liệu, entity, thuc the, thực thể, table, bang, bảng, index, chi muc, chỉ mục, api design, thiet ke api, thiết kế api,
    data model, mo hinh du lieu, mô hình dữ liệu, database, co so du lieu, cơ sở dữ liệu"""
)
NOISE_TOKENS = _words("tmp, test, example, sample, dummy, placeholder, todo, fixme, section, chapter, part, figure, table, header, footer, data, info, details, description, api/v1, v1, v2")
#: Phrases and what they become, applied one after another.
PHRASES = (
    ("db schema", "database schema"), ("database schema", "database schema"), ("schema design", "database schema"), ("data schema", "database schema"),
    ("migration", "database migration"), ("db migration", "database migration"),
    ("api design", "api design"), ("rest api", "api design"), ("grpc api", "grpc design"), ("api endpoint", "api endpoint"), ("endpoint design", "api design"),
    ("srs", "software requirements specification"), ("specification", "specification"), ("requirement spec", "software requirements specification"),
    ("user story", "user story"), ("usecase", "use case"), ("use case", "use case"),
    ("sequence diagram", "sequence diagram"), ("activity diagram", "activity diagram"), ("workflow diagram", "workflow diagram"),
    ("planning", "project planning"), ("plan", "project plan"), ("roadmap", "product roadmap"), ("backlog", "product backlog"), ("sprint planning", "sprint planning"),
    ("ui design", "ui design"), ("ux design", "ux design"), ("component design", "component design"),
    ("system design", "system design"), ("architecture design", "system architecture design"),
    ("feature design", "feature design"), ("business logic", "business logic design"),
)
SMALL_WORDS = _words("for, to, the, and, or, of, in, on, at, by, with, from")

MERGE_VOCABULARY = _words(
    """ai, api, db, ui, ux, sql, http, https, id, jwt, system, architecture, design, module, feature, requirement, scope, diagram, workflow,
    sequence, he thong, hệ thống, kien truc, kiến trúc, thiet ke, thiết kế, phan he, phân hệ, tinh nang, tính năng, yeu cau, yêu cầu,
    pham vi, phạm vi, so do, sơ đồ, quy trinh, quy trình, tuan tu, tuần tự"""
)
MERGE_NOISE_EXACT = _words("out of scope, in scope, api detailed")
MERGE_NOISE = _words(
    """in scope, out of scope, scope definition, feature scope, project scope, scope overview, scope, trong pham vi, ngoai pham vi, pham vi,
    dinh nghia pham vi, pham vi tinh nang, pham vi du an, tong quan pham vi, system design, high level design, low level design,
    detailed design, architecture design, architecture overview, technical design, design document, requirements analysis, analysis document,
    system overview, technical overview, thiet ke he thong, thiet ke tong quan, thiet ke chi tiet, kien truc he thong, tong quan kien truc,
    thiet ke ky thuat, tai lieu thiet ke, dac ta, phan tich yeu cau, tai lieu phan tich, tong quan he thong, tong quan ky thuat,
    sequence diagram, class diagram, use case diagram, flow diagram, state diagram, er diagram, entity relationship diagram, uml diagram,
    activity diagram, so do tuan tu, so do lop, so do use case, so do luong, so do trang thai, so do er, so do quan he thuc the, so do uml,
    so do hoat dong, feature overview, module overview, api detailed, api specification, service overview, system module, tong quan tinh nang,
    tong quan module, api chi tiet, dac ta api, tong quan service, module he thong, improve system, system improvement, enhance system,
    optimize system, refactor system, enhance performance, improve performance, technical improvement, system enhancement, cai thien he thong,
    cai tien he thong, nang cap he thong, toi uu he thong, tai cau truc he thong, cai thien hieu nang, cai thien hieu suat, cai tien ky thuat,
    document analysis, system analysis, requirement analysis, design analysis, planning document, implementation plan, phan tich tai lieu,
    phan tich he thong, phan tich thiet ke, tai lieu ke hoach, ke hoach trien khai, overview, details, detailed, general system, feature module,
    specification, spec, tong quan, chi tiet, he thong tong quat, module tinh nang"""
)
ALIAS_VERBS = _words("create, update, delete, add, remove, implement, fix, build, generate, setup")
INTENT_VERBS = _words("implement, create, design, update, delete, add, setup, configure, verify, test, validate, define")
GENERIC_WORDS = _words("system, pipeline, logic, feature, module")
STOP_WORDS = _words("the, a, an, to, for, of, in, on, with, and, or, by, from")

#: Texts and kinds of the notices that failed jobs send.
PLAN_FAILED = {"event_type": "SPRINT_GENERATION_FAILED", "sender_id": "ai-service", "title": "Sprint generation failed", "message": "Không thể tạo sprint, vui lòng thử lại sau.", "correlation_type": 32, "link": "/groups"}
WORK_FAILED = {"title": "Tạo công việc với AI thất bại", "message": "Hệ thống gặp lỗi khi tạo công việc cho bạn. Vui lòng thử lại sau.", "sender_id": "system", "correlation_type": 2}

SOURCE_RANK = ("Planning", "Design", "Requirement")
ORIGIN_RANK = ("explicit", "derived", "inferred")
ENTROPY_ABOVE, ENTROPY_TOKENS, VOCABULARY_SHARE, SHORTEST_TEXT = 3.6, 8, 0.08, 6
JOIN_CLUSTER, NEAR_COPY, NEAREST_LEAST, SINGLE_LEAST = 0.8, 0.9, 0.35, 0.4
LINK_OVERLAP, LINK_COSINE, LINK_TASK_OVERLAP, COVERED, FLOOR, ALIASES, TITLE_LENGTH = 0.2, 0.5, 0.25, 0.55, 12, 6, 120
