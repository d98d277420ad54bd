"""Fixed rule tables for Vietnamese labour contracts."""

from __future__ import annotations

from provisio.operators.rules import FieldRule, FlagRule

# Mandatory contents and the words that show them.
MANDATORY = (
    FieldRule(
        "employer_identity", "Thông tin NSDLĐ (tên, địa chỉ, người giao kết + chức danh)",
        (r"người\s*sử\s*dụng\s*lao\s*động|NSDLĐ|công\s*ty", r"địa\s*chỉ|MST|mã\s*số\s*doanh\s*nghiệp",
         r"đại\s*diện|giám\s*đốc|chức\s*vụ|chức\s*danh"),
    ),
    FieldRule(
        "employee_identity", "Thông tin NLĐ (họ tên, ngày sinh, CCCD/CMND/hộ chiếu)",
        (r"người\s*lao\s*động|\bNLĐ\b", r"ngày\s*sinh|sinh\s*ngày", r"CCCD|CMND|căn\s*cước|hộ\s*chiếu"),
    ),
    FieldRule(
        "employee_residence", "Nơi cư trú / địa chỉ hiện tại của NLĐ",
        (r"nơi\s*cư\s*trú|địa\s*chỉ\s*hiện\s*tại|địa\s*chỉ\s*thường\s*trú|địa\s*chỉ\s*tạm\s*trú|"
         r"chỗ\s*ở\s*(?:hiện\s*tại|thường\s*trú)|thường\s*trú\s*:|tạm\s*trú\s*:",),
    ),
    FieldRule(
        "job_and_workplace", "Công việc và địa điểm làm việc",
        (r"công\s*việc|chức\s*danh|chức\s*vụ|nội\s*dung\s*công\s*việc",
         r"địa\s*điểm\s*làm\s*việc|đơn\s*vị\s*làm\s*việc|nơi\s*làm\s*việc|phòng\s+"),
    ),
    FieldRule(
        "term", "Thời hạn hợp đồng lao động",
        (r"thời\s*hạn|xác\s*định\s*thời\s*hạn|không\s*xác\s*định\s*thời\s*hạn|từ\s*ngày.+đến",),
    ),
    FieldRule(
        "wage", "Mức lương, hình thức / thời hạn trả lương, phụ cấp và khoản bổ sung",
        (r"mức\s*lương|tiền\s*lương|lương\s*cơ\s*bản|\d[\d\.,]*\s*(?:VNĐ|đồng)",
         r"hình\s*thức\s*trả\s*lương|trả\s*lương|thời\s*hạn\s*trả\s*lương|ngày\s*trả\s*lương"),
    ),
    FieldRule("pay_raise", "Chế độ nâng bậc, nâng lương", (r"nâng\s*bậc|nâng\s*lương|xét\s*nâng\s*lương|điều\s*chỉnh\s*lương",)),
    FieldRule(
        "working_hours_rest", "Thời giờ làm việc, thời giờ nghỉ ngơi",
        (r"thời\s*giờ\s*làm\s*việc|giờ\s*làm\s*việc|\d+\s*tiếng\s*/\s*ngày", r"nghỉ\s*ngơi|nghỉ\s*tuần|nghỉ\s*giữa\s*giờ|ngày\s*nghỉ"),
    ),
    FieldRule("ppe", "Trang bị bảo hộ lao động", (r"bảo\s*hộ\s*lao\s*động|trang\s*bị\s*bảo\s*hộ|phương\s*tiện\s*bảo\s*vệ",)),
    FieldRule(
        "social_insurance", "Bảo hiểm xã hội, bảo hiểm y tế và bảo hiểm thất nghiệp",
        (r"bảo\s*hiểm\s*xã\s*hội|BHXH|bảo\s*hiểm\s*y\s*tế|BHYT|bảo\s*hiểm\s*thất\s*nghiệp|BHTN",),
    ),
    FieldRule(
        "training", "Đào tạo, bồi dưỡng, nâng cao trình độ, kỹ năng nghề",
        (r"đào\s*tạo|bồi\s*dưỡng|nâng\s*cao\s*trình\s*độ|kỹ\s*năng\s*nghề",),
    ),
)

# Risky wordings, their explanation and repair.
RED_FLAGS = (
    FlagRule(
        "ot_unpaid", "Điều 2", "OT không lương / bắt buộc OT", "Làm thêm giờ không trả lương / bắt buộc OT", "critical",
        ("Làm thêm giờ", "Tiền lương OT"),
        r"(không\s*được\s*tính\s*thêm\s*tiền\s*lương\s*làm\s*thêm|không\s*trả\s*(?:thêm\s*)?(?:tiền\s*)?lương\s*làm\s*thêm|"
        r"làm\s*thêm\s*giờ[^\n.]{0,120}không\s*được\s*tính|trách\s*nhiệm\s*làm\s*thêm\s*giờ[^\n.]{0,80}bất\s*cứ\s*khi\s*nào)",
        "Hợp đồng bắt làm thêm và/hoặc tuyên bố không trả lương làm thêm giờ.",
        "Vi phạm quy định về làm thêm giờ và trả lương; rủi ro thanh tra / bồi thường.",
        "Bỏ thỏa thuận OT không lương; OT phải có thỏa thuận và trả đúng hệ số theo BLLĐ.",
        "Điều 98, Điều 107 BLLĐ", (98, 107),
        "Điều 98 & 107 BLLĐ. Người sử dụng lao động phải trả lương làm thêm giờ theo hệ số quy định; "
        "tổ chức làm thêm giờ phải bảo đảm giới hạn thời gian và có sự đồng ý của người lao động theo luật.",
        (
            (
                r"[^.]*?(?:trách\s*nhiệm\s*làm\s*thêm|làm\s*thêm\s*giờ)[\s\S]{0,200}?(?:không\s*được\s*tính|không\s*trả)"
                r"[\s\S]{0,80}?lương\s*làm\s*thêm\s*giờ\.?",
                " Việc làm thêm giờ (nếu có) chỉ thực hiện khi có thỏa thuận và được trả lương "
                "làm thêm giờ theo đúng hệ số quy định của Bộ luật Lao động. ",
            ),
            (
                r"không\s*được\s*tính\s*thêm\s*tiền\s*lương\s*làm\s*thêm\s*giờ",
                "được trả lương làm thêm giờ theo quy định pháp luật",
            ),
        ),
    ),
    FlagRule(
        "no_bhxh", "Điều 3", "Không đóng BHXH/BHYT", "Thỏa thuận không đóng BHXH / BHYT bắt buộc", "critical",
        ("Bảo hiểm xã hội", "BHYT"),
        r"không\s*tham\s*gia\s*đóng\s*Bảo\s*hiểm\s*Xã\s*hội|không\s*đóng\s*(?:BHXH|BHYT)|"
        r"không\s*tham\s*gia\s*(?:đóng\s*)?Bảo\s*hiểm\s*Y\s*tế\s*bắt\s*buộc",
        "Hai bên thỏa thuận Công ty không đóng BHXH/BHYT bắt buộc.",
        "Vi phạm nghĩa vụ tham gia BHXH bắt buộc; xử phạt và truy thu.",
        "Xóa thỏa thuận miễn đóng; thực hiện đóng BHXH/BHYT theo luật.",
        "Điều 21 BLLĐ; Luật BHXH", (21,),
        "Điều 21 BLLĐ. Nội dung chủ yếu của hợp đồng lao động phải có chế độ bảo hiểm xã hội "
        "và bảo hiểm y tế. Nghĩa vụ tham gia BHXH/BHYT bắt buộc không thể thỏa thuận loại trừ.",
        (
            (
                r"(?:Nhằm[^.]*?,\s*)?hai\s*bên\s*thống\s*nhất\s*Công\s*ty\s*sẽ\s*không\s*tham\s*gia\s*đóng\s*"
                r"Bảo\s*hiểm[\s\S]{0,120}?bắt\s*buộc\.?",
                "Công ty thực hiện đóng BHXH, BHYT, BHTN bắt buộc theo quy định pháp luật.",
            ),
            (
                r"Thay\s*vào\s*đó,\s*Công\s*ty\s*sẽ\s*hỗ\s*trợ\s*một\s*khoản\s*tương\s*đương[\s\S]{0,160}?"
                r"tiền\s*lương\s*hàng\s*tháng\s*của\s*NLĐ\.?",
                "",
            ),
        ),
    ),
    FlagRule(
        "retain_id_papers", "Điều 3", "Giữ CCCD / bằng cấp gốc", "Giữ bản gốc giấy tờ tùy thân / bằng cấp của NLĐ", "critical",
        ("Giấy tờ tùy thân", "CCCD"),
        r"bàn\s*giao\s*bản\s*gốc\s*(?:Căn\s*cước|CCCD|CMND|bằng\s*cấp)|giữ\s*(?:bản\s*gốc|CCCD|CMND|giấy\s*tờ)|"
        r"lưu\s*giữ[^\n.]{0,40}(?:CCCD|Căn\s*cước|bằng\s*cấp)",
        "Hợp đồng yêu cầu NLĐ giao bản gốc CCCD/bằng cấp cho Công ty giữ.",
        "Vi phạm cấm giữ giấy tờ gốc của NLĐ.",
        "Xóa quy định giữ bản gốc; chỉ được yêu cầu bản sao khi cần thiết.",
        "Điều 17 BLLĐ", (17,),
        "Điều 17 BLLĐ. Người sử dụng lao động không được giữ bản chính giấy tờ tùy thân, "
        "văn bằng, chứng chỉ của người lao động khi giao kết hoặc thực hiện hợp đồng lao động.",
        (
            (
                r"(?:Để\s*đảm\s*bảo[\s\S]{0,80}?,\s*)?NLĐ\s*đồng\s*ý\s*bàn\s*giao\s*bản\s*gốc[\s\S]{0,200}?"
                r"lưu\s*giữ[\s\S]{0,120}?hợp\s*đồng\s*này\.?",
                "Công ty không giữ bản gốc giấy tờ tùy thân hay bằng cấp của NLĐ; "
                "chỉ yêu cầu bản sao khi cần thiết theo quy định.",
            ),
        ),
    ),
    FlagRule(
        "forfeit_wage_quit", "Điều 3", "Tước lương tháng cuối", "Tước lương tháng cuối khi NLĐ đơn phương chấm dứt", "critical",
        ("Tiền lương", "Chấm dứt HĐLĐ"),
        r"không\s*(?:những\s*)?không\s*được\s*nhận\s*lương|không\s*được\s*nhận\s*lương\s*của\s*tháng\s*cuối|"
        r"tước\s*(?:quyền\s*)?lương|không\s*trả\s*lương\s*tháng\s*cuối",
        "Điều khoản tước lương tháng cuối khi NLĐ chấm dứt trước hạn.",
        "Không được giữ lương đã làm việc; rủi ro tranh chấp và xử phạt.",
        "Xóa quy định tước lương; chỉ được thỏa thuận bồi thường đào tạo đúng luật (nếu có).",
        "Điều 94, Điều 96 BLLĐ", (94, 96),
        "Điều 94 & 96 BLLĐ. Người lao động được trả đủ lương đúng hạn cho thời gian đã làm việc. "
        "Không được tự ý giữ hoặc tước lương tháng cuối vì lý do đơn phương chấm dứt hợp đồng.",
        (
            (
                r"Trường\s*hợp\s*NLĐ\s*đơn\s*phương\s*chấm\s*dứt[\s\S]{0,200}?"
                r"không\s*(?:những\s*)?không\s*được\s*nhận\s*lương[\s\S]{0,80}?\.?",
                "Khi chấm dứt hợp đồng, Công ty thanh toán đầy đủ tiền lương và các khoản NLĐ được hưởng theo pháp luật.",
            ),
        ),
    ),
    FlagRule(
        "fine_deduct_wage", "Điều 4", "Phạt tiền / khấu trừ lương", "Kỷ luật phạt tiền / khấu trừ lương", "critical",
        ("Kỷ luật lao động", "Khấu trừ lương"),
        r"kỷ\s*luật\s*phạt\s*tiền|phạt\s*tiền[^\n.]{0,60}khấu\s*trừ|khấu\s*trừ\s*trực\s*tiếp\s*vào\s*tiền\s*lương|"
        r"hình\s*thức\s*kỷ\s*luật\s*phạt\s*tiền",
        "Công ty tự đặt hình thức kỷ luật phạt tiền và khấu trừ lương.",
        "Phạt tiền không phải hình thức kỷ luật hợp pháp; khấu trừ lương bị hạn chế chặt.",
        "Xóa phạt tiền/khấu trừ kỷ luật; chỉ áp dụng hình thức kỷ luật theo BLLĐ.",
        "Điều 127, Điều 129 BLLĐ", (127, 129),
        "Điều 127 BLLĐ. Nghiêm cấm phạt tiền, cắt lương thay thế việc xử lý kỷ luật lao động. "
        "Hình thức kỷ luật chỉ gồm khiển trách, kéo dài thời hạn nâng lương / cách chức, sa thải (Điều 124).",
        (
            (
                r"(?:Nếu\s*NLĐ[\s\S]{0,120}?,\s*)?Công\s*ty\s*có\s*quyền\s*áp\s*dụng\s*hình\s*thức\s*kỷ\s*luật\s*"
                r"phạt\s*tiền[\s\S]{0,220}?tiền\s*lương\s*hàng\s*tháng\.?",
                "Việc xử lý kỷ luật lao động (nếu có) chỉ áp dụng các hình thức theo Bộ luật Lao động; "
                "không dùng phạt tiền hay khấu trừ lương thay thế kỷ luật.",
            ),
        ),
    ),
    FlagRule(
        "terminate_pregnancy", "Điều 4", "Chấm dứt vì kết hôn / mang thai", "Đơn phương chấm dứt HĐLĐ vì kết hôn / mang thai", "critical",
        ("Bảo vệ lao động nữ", "Đơn phương chấm dứt"),
        r"chấm\s*dứt[^\n.]{0,80}(?:kết\s*hôn|mang\s*thai)|(?:kết\s*hôn|mang\s*thai)[^\n.]{0,80}chấm\s*dứt|"
        r"đơn\s*phương\s*chấm\s*dứt[^\n.]{0,100}(?:kết\s*hôn|mang\s*thai)",
        "Cho phép NSDLĐ đơn phương chấm dứt khi NLĐ kết hôn hoặc mang thai.",
        "Phân biệt đối xử / vi phạm bảo vệ thai sản; điều khoản vô hiệu, rủi ro bồi thường.",
        "Xóa toàn bộ lý do chấm dứt liên quan kết hôn/mang thai.",
        "Điều 137, Điều 141 BLLĐ", (137, 141),
        "Điều 137 & 141 BLLĐ. Người sử dụng lao động không được sa thải hoặc đơn phương chấm dứt "
        "hợp đồng lao động đối với lao động nữ vì lý do kết hôn, mang thai, nghỉ thai sản.",
        (
            (
                r"Công\s*ty\s*có\s*quyền\s*đơn\s*phương\s*chấm\s*dứt[\s\S]{0,220}?(?:kết\s*hôn|mang\s*thai)"
                r"[\s\S]{0,120}?hợp\s*đồng\.?",
                "Công ty không đơn phương chấm dứt hợp đồng vì lý do kết hôn, mang thai hoặc nghỉ thai sản.",
            ),
        ),
        r"(?:mang\s*thai|thai\s*sản).{0,80}(?:chấm\s*dứt|sa\s*thải)|(?:chấm\s*dứt|sa\s*thải).{0,80}(?:mang\s*thai|thai\s*sản)",
    ),
    FlagRule(
        "ban_lawsuit", "Điều 5", "Cấm khởi kiện ra Tòa", "Cấm NLĐ khởi kiện ra Tòa án", "critical",
        ("Giải quyết tranh chấp", "Quyền khởi kiện"),
        r"không\s*được\s*(?:quyền\s*)?khởi\s*kiện|không\s*được\s*kiện\s*ra\s*Tòa|"
        r"quyết\s*định\s*cuối\s*cùng[^\n.]{0,80}không\s*được|Giám\s*đốc[^\n.]{0,60}quyết\s*định\s*cuối\s*cùng",
        "Hạn chế quyền khởi kiện / trao quyền quyết định tranh chấp một phía cho Giám đốc.",
        "Điều khoản vô hiệu; NLĐ vẫn có quyền khởi kiện theo pháp luật.",
        "Sửa điều khoản tranh chấp: thương lượng, hòa giải, Tòa án theo BLLĐ/BLTTDS.",
        "Điều 179, Điều 187 BLLĐ", (179, 187),
        "Điều 179 & 187 BLLĐ. Tranh chấp lao động được giải quyết theo thương lượng, hòa giải và Tòa án. "
        "Không được thỏa thuận tước quyền khởi kiện của người lao động.",
        (
            (
                r"Mọi\s*tranh\s*chấp[\s\S]{0,200}?(?:quyết\s*định\s*cuối\s*cùng|không\s*được\s*(?:quyền\s*)?khởi\s*kiện)"
                r"[\s\S]{0,120}?Tòa\s*án\.?",
                "Mọi tranh chấp phát sinh từ Hợp đồng này được giải quyết trước hết bằng thương lượng; "
                "nếu không được thì thông qua hòa giải hoặc Tòa án có thẩm quyền theo pháp luật Việt Nam.",
            ),
        ),
    ),
)
