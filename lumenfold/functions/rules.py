"""Vocabularies and limits that decide results. All are data: every operator takes its own as a parameter."""

from __future__ import annotations

# They must be equal for equal results.
CATEGORY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "AI/机器学习": ("人工智能", "机器学习", "深度学习", "神经网络", "大模型", "训练", "推理", "算法", "AI"),
    "Web 开发": ("前端", "后端", "React", "Vue", "JavaScript", "TypeScript", "HTML", "CSS", "接口", "API", "Web"),
    "数据库": ("数据库", "SQL", "MySQL", "PostgreSQL", "Redis", "索引", "事务", "查询优化"),
    "运维": ("运维", "部署", "Docker", "Kubernetes", "CI/CD", "监控", "容器", "服务器"),
    "安全": ("安全", "漏洞", "加密", "攻击", "防护", "认证", "XSS", "注入"),
    "产品设计": ("产品", "设计", "用户体验", "交互", "需求", "原型", "UX", "UI"),
}
TAG_KEYWORDS: dict[str, tuple[str, ...]] = {
    "机器学习": ("机器学习", "模型", "训练"),
    "深度学习": ("深度学习", "神经网络", "Transformer", "CNN"),
    "Python": ("python", "pip", "django", "flask"),
    "前端": ("前端", "react", "vue", "css"),
    "数据库": ("数据库", "sql", "索引"),
    "DevOps": ("docker", "kubernetes", "ci/cd", "部署"),
    "安全": ("安全", "漏洞", "加密"),
}
TITLE_WEIGHT, BODY_WEIGHT, MOST_TAGS = 3, 1, 5
DEFAULT_CATEGORIES = ("AI/机器学习", "Web 开发", "数据库", "运维", "安全", "产品设计", "其他")
FALLBACK_CATEGORY, UNCATEGORIZED_LABEL, UNKNOWN_SOURCE, UNKNOWN_TIME = "其他", "未分类", "未知来源", "时间未知"

LEAST_CONTENT, LEAST_LINK_RATIO, SHORT_PAGE = 10, 0.5, 200
AD_PHRASES = ("立即购买", "点击购买", "限时优惠", "扫码关注", "加微信", "点击咨询", "立即下载", "领取优惠")
NAV_PHRASES = ("首页", "导航", "目录", "404", "页面不存在", "站点地图")
ENTRY_REASON, SHORT_REASON, EXCLUDED_REASON = "来源入口页（首页/栏目页），不作为文章", "内容过短，疑似非文章页", "命中排除词: "
NAV_REASON, AD_REASON, LINKS_REASON = "疑似导航/占位页", "疑似广告页: ", "链接密度过高，疑似导航/聚合页"
LIST_SEPARATOR = "、"

DATE_PATH = r"/(?:19|20)\d{2}(?:[/-]\d{1,2})?(?:[/-]\d{1,2})?"
ARTICLE_SEGMENTS = ("article", "articles", "post", "posts", "archives", "archive", "news", "story", "stories", "blog", "p", "entry", "entries")
NAV_SEGMENTS = (
    "about", "contact", "guestbook", "plugins", "featured", "feed", "rss", "login", "signin", "signup", "register", "search", "tag", "tags", "category", "categories", "author", "authors",
    "page", "privacy", "terms", "advertise", "subscribe", "donate", "comment", "comments", "help", "faq", "sitemap", "index", "home", "blogroll", "links", "friends",
)
GENERIC_ANCHORS = (
    "更多", "更多内容", "阅读更多", "阅读全文", "详情", "点击查看", "首页", "关于", "关于我", "联系", "登录", "注册", "归档", "目录",
    "more", "read more", "home", "about", "contact", "login", "next", "previous",
)
SKIPPED_LINKS = ("#", "mailto:", "javascript:", "tel:")
COLLECT_TIMES, MOST_LINKS = 5, 20

TITLE_PENALTIES = ("首页", "无标题", "untitled", "404", "导航", "目录")
# Evidence of relations. Numbers stand for %s in order.
PRIMARY_EVIDENCE, EXACT_EVIDENCE = "合并组主记录", "正文指纹相同（仅模板/导航差异）"
NEAR_EVIDENCE, RELATED_EVIDENCE = "SimHash 相似度 %.3f ≥ 阈值 %.2f", "相似度 %.3f < 合并阈值 %.2f，按不同视角关联（不合并）"

HIDDEN_STATUSES = ("filtered", "error", "knowledge_duplicate")
MERGE_TYPES = ("exact_duplicate", "near_duplicate")
RELATION_TYPES = ("exact_duplicate", "near_duplicate", "related")
DIGEST_STATUSES = ("pending", "sent", "failed", "skipped_empty")
NEAR_THRESHOLD, RELATED_THRESHOLD = 0.90, 0.5
COVERED_SIMILARITY, NEW_SIMILARITY = 0.92, 0.80
INTERVALS = {"high": 3 * 3600, "normal": 24 * 3600, "low": 7 * 24 * 3600}
PERIOD_DAYS = {"daily": 1, "weekly": 7}
TOPIC_LABELS = {"source": "来源：", "category": "类别：", "tag": "标签：", "keyword": "关键词："}
HEALTH_SAMPLE = 50
MOST_TOPICS, MOST_KEYWORD, MOST_ITEMS = 20, 50, 50
# The words of a digest mail.
FREQUENCY_LABELS = {"daily": "每日", "weekly": "每周"}
MAIL_HEADING, MAIL_NOTHING, MAIL_NO_SUMMARY, MAIL_NOTE, MAIL_DOT, MAIL_LEAVE = "订阅摘要", "本周期没有新的相关内容。", "（暂无摘要）", "本邮件由自动推送生成，请勿直接回复。", "　·　", "一键退订"
MAIL_WHY, MAIL_LEAVE_TEXT = "你收到这封邮件是因为你订阅了本站的内容方向：", "不想再收到？点击退订："
# Why a knowledge decision was made. Numbers stand for %s in order.
NO_SIMILAR, COVERED_BY, JUDGED_COVERED, TAKEN_AS_NEW = "Wiki 中暂无相似知识点", "与条目相似度 %.2f ≥ %.2f，判定已被覆盖", "相似度 %.2f 处于中间区间，模型二次判定为已覆盖", "相似度 %.2f 未达到覆盖阈值，保守判定为新增知识"
ALL_COVERED, SOME_COVERED, NONE_COVERED = "%d 个知识点均已在 Wiki 中覆盖（最高相似度 %.2f），判定为知识重复", "%d 个知识点已覆盖、%d 个为新增（最高相似度 %.2f），按部分新增处理", "%d 个知识点均为新增（最高相似度 %.2f）"
NO_POINTS, EXTRACTION_FAILED, UNKNOWN_REASON = "未提炼出可复用的知识点，视为全新内容", "知识点提炼失败，待后续重试：", "未知原因"
BROKEN_PAGE, NO_PAGE = "the page breaks the parser", "no page"
# Why a model gave no answer.
MODEL_TIMEOUT, MODEL_DOWN, MODEL_QUOTA, MODEL_STATUS = "LLM 调用超时：%s", "LLM 调用失败：%s", "LLM 限流或配额不足（HTTP 429）", "LLM 返回错误状态：HTTP %d"
MODEL_NO_JSON, MODEL_SHAPE, MODEL_VECTOR = "LLM 返回内容不是合法 JSON", "LLM 输出无法解析为约定 JSON：%s", "embedding 响应结构异常：%s"
EMBED_CHARS = 4000
EXTRACT_PROMPT = 'Name one to five reusable findings of the article. Answer with JSON alone: {"points": [{"name": "", "summary": "", "claims": [""]}]}; without findings the list is empty.'
JUDGE_PROMPT = 'Does the known entry already say all that the new point says? Answer with JSON alone: {"covered": true} or {"covered": false}. If in doubt: false.'
SETTING_DEFAULTS = {
    "default_frequency": "weekly", "max_items_per_digest": "10", "send_window_start_hour": "9", "send_window_end_hour": "21",
    "send_empty_digest": "false", "max_retries": "3", "sends_paused": "false", "bounce_pause_threshold": "0.05",
}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
STRIPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
BLOCK_TAGS = ("p", "h2", "h3", "li", "blockquote", "pre")
ENUMS: dict[str, tuple[str, ...]] = {
    "article_status": ("pending", "normal", "uncategorized", "error", "filtered", "knowledge_duplicate"),
    "knowledge_status": ("new", "partial", "covered", "pending"),
    "crawl_status": ("fetched", "failed", "robots_denied", "skipped"),
    "list_type": ("whitelist", "blacklist", "neutral"),
    "subscription_status": ("pending_confirmation", "confirmed", "unsubscribed"),
    "digest_status": DIGEST_STATUSES,
    "wiki_status": ("active", "retired", "merged"),
    "extraction_status": ("pending", "ok", "failed"),
    "category_status": ("active", "inactive"),
    "category_action": ("create", "rename", "merge", "deactivate", "activate"),
    "relation_type": RELATION_TYPES,
    "update_frequency": ("high", "normal", "low", "custom"),
    "subscription_frequency": ("daily", "weekly"),
    "knowledge_decision": ("new_knowledge", "partial", "covered", "pending"),
    "topic_type": ("category", "keyword", "source", "tag"),
}
