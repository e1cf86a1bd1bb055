"""Fixed values of the page-distillation rules, as plain data."""

from __future__ import annotations

# ---- Fixed values: the text below must stay as it is for equal results. ----

# Ordered (pattern, replacement) pairs of text cleaning.
CLEAN_CHAIN = [
    (r"[\t\n\f\r ]{255,}", " " * 255),
    (r"[\t\n\f\r ]*\n[\t\n\f\r ]*", "\n"),
    (r"\t|[ \t]{2,}", " "),
    (r"<[^/>]+>[ \n\r\t]*</[^>]+>", ""),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("…", "...."),
    ("—", "-"),
    ("–", "-"),
]

USELESS_TAGS = ["header", "script", "style", "footer", "comment", "aside", "nav", "noscript", "symbol", "button", "input", "select"]
TITLE_PAIRS = [("【", "】"), ("[", "]"), ("「", "」"), ("（", "）"), ("(", ")")]
TITLE_SPLIT = r"[-_|｜]"
TITLE_RATIO = 0.7
# Styles that pages of a site need.
SITE_STYLES = {"web.okjike.com": "\nbr {\n  line-height: normal;\n}"}

# Labels whose text is cleared, and the one that only gets a mark.
CLEARED_LABELS = ["O", "article_title", "publish_time", "author", "source"]
MARKED_LABELS = {"reference": "reference"}
# Labels of subtrees: mark, and whether a window must stay in one paragraph.
SUBTREE_LABELS = {
    "introduction": ("intro", False), "abstract": ("intro", False), "catalog": ("intro", False), "figure_title": ("legend", False),
    "title1": ("h1", True), "title2": ("h2", True), "title3": ("h3", True), "title4": ("h4", True), "title5": ("h5", True),
}
LABEL_NOISE, LABEL_CONTENT, LABEL_FIGURE = "O", "content", "figure"
OK_CANDIDATE = "and|article|body|column|main|shadow|nickname"
POSITIVE = "article|artic|body|content|entry|hentry|main|page|pagination|post|text|blog|story|title"
NOISE_ATTR = "data-ad"
NEGATIVE_IMG = "avatar|logo|author|title|标题|weibo|wechat|weixin|icon|公众号|更多|关注|landing|loading"
NEGATIVE_LINK = "更多|详细|关注|aboutus|公众号|wechat|weibo"
PROFILE_IMG = r'var hd_head_img = "(.*?)"'
AUTHOR_DESCRIPTION = r'var profile_signature = "(.*?)"'
AUTHOR_ID = r'var biz = "(.*?)"'
AUTHOR_NAME = r'window.name = "(.*?)"'
UNDELETABLE = ["html", "body", "article", "title", "li", "p"]

IMAGE_TAGS = ["img", "map", "area", "canvas", "picture", "figure", "svg"]
IMAGE_ATTRS = ["src", "_src", "data-src", "data-original", "data-lazy-bgimg", "data-lazy-src"]
ANCHOR_ATTRS = ["href", "data-href"]
STOPS_CN = ["？", "！", "。", "…", "：", "；", ":"]
STOPS_EN = ["?", "!", ":", ";"]
CLOSERS = ['"', "”", "’", "」", ")", "）"]
GOLD_TAGS = {
    "h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "h5": "h5", "h6": "h6", "strong": "strong", "b": "b", "em": "em", "hr": "hr", "br": "br",
    "img": "img", "map": "img", "area": "img", "canvas": "img", "picture": "img", "figure": "img", "svg": "img", "figcaption": "figcaption",
    "table": "table", "th": "table", "tr": "table", "td": "table", "thead": "table", "tbody": "table", "tfoot": "table", "col": "table",
    "colgroup": "table", "caption": "caption", "menu": "li", "ul": "li", "ol": "li", "li": "li", "dl": "li",
}
PARAGRAPH_TAGS = ["p", "div", "tr", "li", "section", "figcaption", "dd", "dt", "br", "h1", "h2", "h3", "h4", "h5", "h6"]
VIDEO_CLASS_PARTS = ["video_iframe", "cne-video-embed", "ytp-cued-thumbnail-overlay-image", "pbs__player", "player__bg"]
VIDEO_CLASSES = ["qvt-video-container", "embed-container"]
STYLE_KEPT = ["color", "font-style", "background", "background-color", "list-style", "font-weight", "text-indent", "border-left", "border-radius", "padding-right", "padding-left"]
STYLE_KEPT_IMAGE = ["width", "height", "vertical-align"]
ATTRS_KEPT = ["xpath", "position_id", "viewBox", "style", "height"]
WHITE = ["#ffffff", "#fff", "white", "transparent"]

AUTHOR_KEYWORDS = ["作者", "原创", "来源", "出品", "文", "责编", "责任编辑", "编辑", "撰文", "文案", "文字", "翻译", "报道", "记者", "校对", "设计制作", "设计", "审核", "美编", "ID", "排版", "热门专栏", "整理", "编导", "策划"]
AUTHOR_META = ["author", "article:author"]
DESCRIPTION_META = ["description", "og:description"]
IMAGE_META = ["og:image"]
TITLE_META = ["og:title"]
# Ordered (attribute, prefix of its value) of the meta elements that hold a publish time.
TIME_META = [
    ("property", "rnews:datePublished"), ("property", "article:published_time"), ("property", "og:published_time"), ("property", "og:release_date"),
    ("itemprop", "datePublished"), ("itemprop", "dateUpdate"), ("name", "citation_date"), ("name", "OriginalPublicationDate"),
    ("name", "article_date_original"), ("name", "og:time"), ("name", "apub:time"), ("name", "publication_date"), ("name", "sailthru.date"),
    ("name", "PublishDate"), ("name", "publishdate"), ("name", "PubDate"), ("name", "pubtime"), ("name", "_pubtime"),
    ("name", "weibo: article:create_at"), ("pubdate", "pubdate"),
]
CREATE_TIME = "var createTime = '(.+?)';"
# Ordered date-time searches.
TIME_PATTERNS = [
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2}\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{4}年\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{2}年\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[0-1]?[0-9]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[2][0-3]:[0-5]?[0-9])",
    r"(\d{1,2}月\d{1,2}日\s*?[1-24]\d时[0-60]\d分)([1-24]\d时)",
    r"(\d{4}[-|/|.]\d{1,2}[-|/|.]\d{1,2})",
    r"(\d{1,2}[-|/|.]\d{1,2}[-|/|.]\d{4})",
    r"(\d{2}[-|/|.]\d{1,2}[-|/|.]\d{1,2})",
    r"(\d{4}年\d{1,2}月\d{1,2}日)",
    r"(\d{2}年\d{1,2}月\d{1,2}日)",
    r"(\d{1,2}月\d{1,2}日)",
]
# Ordered layouts of a date-time, after weekday and zone are taken off.
TIME_LAYOUTS = [
    "MM/dd hh:mm:ssa ''yy", "MMM d HH:mm:ss yyyy", "dd MMM yy H:mm", "dd-MMM-yy H:mm:ss", "dd MMM yyyy H:mm:ss",
    "yyyy-MM-dd'T'H:mm:ss", "yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd",
    "MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "yyyy/MM/dd H:mm:ss", "yyyy/MM/dd H:mm",
    "yyyy年MM月dd日 H:mm", "yyyy年MM月dd日 H:mm:ss", "yyyy年MM月dd日 H时mm分", "yyyy年MM月dd日 H时mm分ss秒",
    "d MMMM yyyy", "d MMMM, yyyy", "d MMM yyyy", "d MMM, yyyy", "dd.MM.yyyy", "M/d/yyyy", "MM/dd/yyyy",
]

YEARLESS_LAYOUTS = ["MMM d H:mm:ss", "h:mma"]

WORTHLESS_CHARS, WORTHLESS_RATIO = 100, 0.75
WORTHLESS_TITLES = ["账号已迁移", "page not found", "Captcha Interception", "安全验证", "404页面", "404 Not Found", "403 Forbidden", "页面没有找到", "找不到我要找的页面"]
WORTHLESS_KEYWORDS = [
    ["已删除", "不存在", "页面", "跳回"], ["节点", "域名", "存在"], ["端口", "域名", "绑定"], ["nginx", "404", "403"], ["请求", "非法"],
    ["网站", "无法", "访问"], ["content", "deleted", "author"], ["No", "page", "found", "not"], ["内容", "发布者", "删除", "作者"],
    ["抱歉", "页面", "没", "找到"], ["抱歉", "网页", "出错"], ["自动", "跳转", "首页"], ["内容", "违规", "无法", "查看"], ["链接", "不", "访问"],
    ["公众号", "已迁移"], ["网络", "稍后", "重试"], ["文章", "找不到"], ["检查", "网址", "是否正确"], ["输入", "错误", "重新"],
]

# Phrases of small notices, and the longest text (in code points) that is one.
TINY_NOISE = [
    ("经授权转载", 70),
    ("/摄）", 40),
    ("本系列评论到此结束", 15),
    ("左起：", 20),
    ("文末有抽奖", 30),
    ("长按下方二维码即可报名！", 30),
    ("点击上方", 30),
    ("点击即刻报名", 30),
    ("阅读原文", 40),
    ("点击获取", 30),
    ("点击图片", 30),
    ("点击查看", 30),
    ("文献审核|", 30),
    ("举报电话：", 30),
    ("邮箱：", 30),
    ("点击下方图片", 100),
    ("本文来自微信公众号", 40),
    ("点击下方卡片关注", 40),
    ("监制", 30),
    ("微博：", 15),
    ("转载", 30),
    ("主播|", 30),
    ("主播 |", 30),
    ("主播 |", 30),
    ("关注【视频号】", 30),
    ("专属直播", 30),
    ("每日金曲：", 30),
    ("朗读音频", 15),
    ("朗诵 |", 15),
    ("播放按钮", 30),
    ("版权声明：", 80),
    ("实习生|", 30),
    ("实习生 ", 15),
    ("排版 |", 30),
    ("专业支持 /", 30),
    ("点击", 5),
    ("一个AI", 5),
    ("请联系", 30),
    ("品牌提供", 40),
    ("报告编号：", 30),
    ("分割线", 30),
    ("听我讲丨", 30),
    ("动图截自", 30),
    ("文末有视频", 30),
    ("不要忘记看", 10),
    ("左滑", 10),
    ("点赞关注支持", 40),
    ("点赞关注", 40),
    ("咱们直接出厂价", 30),
    ("点击下图", 50),
    ("公司授权", 20),
    ("专栏介绍", 10),
    ("圈长寿", 30),
    ("公众号的粉丝", 20),
    ("公众号的圈友", 20),
    ("上下滑动", 30),
    ("左右滑动", 30),
    ("长按扫码", 20),
    ("招聘丨", 30),
    ("文献审核 |", 30),
    ("欢迎扫描二维码", 50),
    ("感谢读者朋友", 50),
    ("问卷结果推文", 50),
    ("邮件联系", 30),
    ("你已选中了添加链接的内容", 20),
    ("摄图网", 3),
    ("支持三档控温，不用", 25),
    ("广告", 2),
    ("▲“吊打”", 15),
    ("国标II级，暴雨级防水！", 15),
    ("解球竞彩", 30),
    ("预测下载APP", 30),
    ("向下滑动查看", 10),
    ("热门活动推荐", 15),
    ("热门视频推荐", 15),
    ("亲笔", 10),
    ("点个在看", 25),
    ("点亮在看", 25),
    ("文末点亮", 25),
    ("点个【在看】", 25),
    ("点☆在看", 25),
    ("点个“在看”", 25),
    ("点亮【在看】", 25),
    ("识别二维码", 40),
    ("欢迎大家积极", 15),
    ("侵删", 15),
    ("长按下方", 15),
    ("加星标", 25),
    ("看更多", 15),
    ("示意图", 15),
    ("关注它，能", 20),
    ("公众号ID：", 20),
    ("公众号名称：", 20),
    ("声音 |", 10),
    ("微信ID", 20),
    ("猛戳图片", 20),
    ("开团价", 10),
    ("电商广告", 10),
    ("小红书：", 10),
    ("合作wx：", 10),
    ("长按识别", 10),
    ("- End -", 10),
    ("本文首发于", 15),
    ("欢迎订阅", 15),
    ("敬请关注", 60),
    ("钜惠倒计时", 30),
    ("戳图片", 10),
    ("观看更多", 10),
    ("更多阅读", 10),
    ("首发于", 15),
    ("扫描上方二维码", 15),
    ("感谢实习生", 15),
    ("更多精彩敬请期待", 50),
    ("新智元报道", 10),
    ("供图", 10),
    ("联系电话", 10),
    ("▼最后", 15),
    ("整理丨", 15),
    ("整理 |", 15),
    ("整理｜", 15),
    ("采访丨", 15),
    ("/发自", 15),
    ("文章来自", 10),
    ("本文综合自：", 15),
    ("鸣谢：", 15),
    ("通讯员：", 15),
    ("运营：", 15),
    ("排版：", 15),
    ("语音支持丨", 15),
    ("分享嘉宾：", 45),
    ("本文由", 15),
    (" 发表于", 25),
    ("文亦有贡献）", 25),
    ("点击此处获悉详情", 10),
    ("截图自", 20),
    ("，钛媒体App制图", 20),
    ("请您关注", 10),
    ("统筹：", 15),
    ("图片素材来源：", 20),
    ("海报：", 15),
    ("本周精彩，尽在此氪。", 10),
    ("查看更多项目信息，请前往", 20),
    ("「定焦」制图", 10),
    ("本札记作于", 20),
    ("购书链接", 15),
    ("送书活动", 15),
    ("注：活动结束", 15),
    ("辛苦点个赞", 15),
    ("暂时写到这里", 15),
    ("感谢大家的鼓励", 15),
    ("请大家批评指正", 20),
    ("评论区留言", 50),
    ("京东链接", 50),
    ("来自网页", 20),
    ("工作总结：", 30),
    ("添加微信：", 40),
    ("关注一下博主", 80),
    ("关注博主", 20),
    ("一键三连", 20),
    ("逢考必过", 20),
    ("本文原创", 20),
    ("禁止转载", 20),
    ("如果本文对你有帮助", 30),
    ("个人主页", 50),
    ("热门专栏:", 50),
    ("热门专栏：", 50),
    ("多多支持", 20),
    ("完结撒花", 30),
    ("感谢关注", 50),
    ("感谢您的支持和鼓励", 20),
    ("点击下方小卡片", 30),
    ("多多点赞收藏评论", 30),
    ("点个", 10),
    ("你的喜欢", 20),
    ("文章如有错误", 40),
    ("动手点赞鼓励", 40),
    ("（执笔：", 20),
    ("后台回复", 40),
    ("更多消息", 20),
    ("戳下方小程序查看", 30),
    ("—版权声明—", 30),
    ("部分图片来源网络", 40),
    ("有用的知识又增加", 15),
    ("点赞+分享", 10),
    ("本条资讯来源", 50),
    ("公众号消息：", 30),
    ("图片均来源于网络", 30),
    ("互动话题：", 50),
    ("微博 -", 30),
    ("再逛逛", 10),
    ("返回搜狐，查看更多", 15),
    ("责任编辑：", 10),
    ("滑动看下一个", 10),
    ("向上滑动看下一个", 10),
    ("继续滑动看下一个", 10),
    ("相关阅读", 10),
    ("更多阅读", 10),
    ("观看更多精彩视频", 10),
    ("热点视频", 5),
    ("近期直播推荐", 10),
]

# ---- End of fixed values. ----
