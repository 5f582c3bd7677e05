"""Names under which sources report the standard statement items."""

from __future__ import annotations

# Standard key, statement, aliases.
METRIC_ALIASES = [
    ("total_assets", "BS", ["Total Assets", "TOTAL ASSETS", "TỔNG CỘNG TÀI SẢN", "Tổng tài sản", "Total assets balance"]),
    ("current_assets", "BS", ["Current Assets", "Tài sản ngắn hạn", "TỔNG TÀI SẢN NGẮN HẠN", "Short-term assets"]),
    ("inventory", "BS", ["Inventory", "Hàng tồn kho", "Hàng tồn kho ròng", "Inventories net"]),
    ("current_liabilities", "BS", ["Current Liabilities", "Nợ ngắn hạn", "Nợ phải trả ngắn hạn", "Short-term liabilities"]),
    ("total_liabilities", "BS", ["Total Liabilities", "Tổng nợ phải trả", "TỔNG CỘNG NỢ PHẢI TRẢ", "Liabilities total"]),
    ("equity", "BS", ["Owner Equity", "Vốn chủ sở hữu", "VỐN CHỦ SỞ HỮU", "Stockholders equity"]),
    ("retained_earnings", "BS", ["Retained Earnings", "Lợi nhuận sau thuế chưa phân phối", "LNST chưa phân phối"]),
    ("net_revenue", "IS", ["Net Revenue", "Doanh thu thuần", "Doanh thu bán hàng và cung cấp dịch vụ", "Net sales"]),
    ("ebit", "IS", ["EBIT", "Lợi nhuận trước thuế", "Tổng lợi nhuận kế toán trước thuế", "Earning before tax"]),
    ("net_profit", "IS", ["Net Profit", "Lợi nhuận sau thuế", "LNST của cổ đông công ty mẹ", "Profit after tax"]),
    ("interest_expense", "IS", ["Interest Expense", "Chi phí lãi vay", "Trong đó: Chi phí lãi vay", "Finance interest cost"]),
    ("operating_cash_flow", "CF", ["Operating Cash Flow", "Lưu chuyển tiền thuần từ hoạt động kinh doanh", "OCF net"]),
]

# Currency units in single currency units.
UNITS = {"VND": 1.0, "THOUSAND_VND": 1e3, "MILLION_VND": 1e6, "BILLION_VND": 1e9}

STATEMENT_OF = {key: kind for key, kind, _ in METRIC_ALIASES} | {
    "long_term_debt": "BS",
    "cogs": "IS",
    "market_cap": "MARKET",
}
