
NAMED_IDS = {
    "Q01": ["top_ship_mode_by_state"], "Q02": ["ship_mode_winner_tally"], "Q03": ["segment_order_count"],
    "Q04": ["product_subcat_region_count", "products_by_units_sold"], "Q05": ["sales_by_month"], "Q06": ["sales_by_month_state"],
    "Q07": ["sales_month_subcat_rollup"], "Q08": ["customer_totals", "customer_extremes"],
    "Q09": ["returned_orders_by_region", "returned_orders_by_region_month", "peak_return_period"], "Q10": ["refined_order_priority"],
    "Q11": ["region_sales_contribution"], "Q12": ["month_region_contribution"], "Q13": ["returned_order_details"],
    "Q14": ["lookup_row", "lookup_return"], "Q15": ["long_subcategory_names"], "Q16": ["relabel_subcategory"],
    "Q17": ["monthname_region_sales_profit"], "Q18": ["scan_orders", "scan_returns"],
    "Q19": ["region_priority_container_index"], "Q20": ["region_sales_and_lines"],
    "Q21": ["manager_monthly_bonus"], "Q22": ["bonus_rollup"], "Q23": ["cities_per_region"],
    "Q24": ["states_per_city"], "Q25": ["customers_in_city"], "Q26": ["city_repeated_in_region"],
    "Q27": ["city_drilldown"], "Q28": ["city_repeated_states"], "Q29": ["yearmonth_subcat_sales"],
    "Q30": ["yearmonth_category_sales"], "Q31": ["covered_city_count"], "Q32": ["ship_mode_cities_by_state"],
    "Q33": ["widest_ship_mode_by_state"], "Q34": ["customers_3plus_lines_month"], "Q35": ["customer_month_lines"],
    "Q36": ["customers_3plus_days_month"], "Q37": ["top2_products_per_category"], "Q38": ["product_sales"],
    "Q39": ["product_avg_sales"], "Q40": ["product_avg_prefix"], "Q41": ["lines_below_product_avg"],
    "Q42": ["customer_day_below_product_avg"], "Q43": ["region_active_customers"],
    "Q44": ["month_region_engagement"], "Q45": ["customers_in_n_categories"],
    "Q46": ["customers_by_value_bracket"], "Q47": ["products_in_n_regions"], "Q48": ["product_region_drill"],
    "Q49": ["subcategory_count"], "Q50": ["subcategories_per_region"], "Q51": ["subcat_cumulative_pct"],
    "Q52": ["top_subcat_per_region"], "Q53": ["top_subcat_per_region_rank"], "Q54": ["customer_first_order"],
    "Q55": ["customer_lifespan"], "Q56": ["lifespan_bins"], "Q57": ["customer_lines"],
    "Q58": ["coupon_eligibility"], "Q59": ["top_product_per_state"], "Q60": ["lines_above_month_avg"],
    "Q61": ["lines_above_month_region_subcat_avg"], "Q62": ["best_and_worst_cells", "sales_extremes"],
    "Q63": ["priority_by_region_state"], "Q64": ["priority_counts"], "Q65": ["retention_monthly"],
    "Q66": ["retention_crosscheck"], "Q67": ["churn_monthly"], "Q68": ["product_name_regex"],
    "Q69": ["orders_with_returns"], "Q70": ["state_share_of_totals"], "Q71": ["nth_sales_value"],
    "Q72": ["sales_value_index"], "Q73": ["mom_sales_diff"], "Q74": ["avg_mom_pct_change"],
    "Q75": ["avg_line_vs_avg_month"], "Q76": ["month_region_sales"], "Q77": ["customer_months"],
    "Q78": ["customer_month_retained_flag"], "Q79": ["retained_flag_by_geo"], "Q80": ["describe_orders"],
    "Q81": ["ship_mode_counts"], "Q82": ["order_line_vs_order_count"], "Q83": ["best_ship_mode_by_state"],
    "Q84": ["subcat_share_in_category"], "Q85": ["median_profit"], "Q86": ["top_state_per_month"],
    "Q87": ["month_share_of_sales_profit"], "Q88": ["total_sales"], "Q89": ["pct_growth_per_month"],
    "Q90": ["row_count"],
}

DESCRIBED_IDS = {
    "D01": ["total_ytd", "total_ytd_calendar"], "D02": ["same_period_last_year", "same_period_calendar"], "D03": ["summarize"], "D04": ["add_columns"],
    "D05": ["categorize"], "D06": ["value_if_single"], "D07": ["lookup_related"], "D08": ["row_level_security"],
    "D09": ["bidirectional_filter"], "D10": ["null_profile"], "D11": ["impute_median"], "D12": ["iqr_outliers"],
    "D13": ["winsorize"], "D14": ["box_stats"], "D15": ["category_frequency"], "D16": ["correlation_matrix"],
    "D17": ["binned_pairs"], "D18": ["deduplicate", "duplicate_summary", "inconsistent_names"], "D19": ["validate"],
    "D20": ["normalize"], "D21": ["attrition_by_year_top"], "D22": ["top_roles_per_department"],
    "D23": ["top_groups"], "D24": ["age_brackets"], "D25": ["avg_by_group"],
    "D26": ["gender_by_bracket", "gender_by_bracket_group"], "D27": ["snowflake_join"], "D28": ["review_history"],
    "D29": ["hiring_trend"], "D30": ["rate_by_factor", "rate_within_department", "attrition_factors", "return_factors"], "D31": ["rate_by_year"], "D32": ["rate_by_tenure", "risky_tenure", "survival_by_tenure", "median_tenure"],
    "D33": ["weekly_trend", "monthly_trend", "moving_average_calendar"], "D34": ["seasonality_index"], "D35": ["sales_anomalies"],
    "D36": ["kpi_summary", "rolling_customers"], "D37": ["mom_change", "mom_change_calendar"], "D38": ["churn_retention_corr"], "D39": ["true_churn"],
    "D40": ["customer_lifetime_value", "clv_drivers", "customer_lifetime_forecast"], "D41": ["geo_performance"], "D42": ["segment_performance"],
    "D43": ["orders_by_category"], "D44": ["sales_by_weekday"],
    "D45": ["shipping_effectiveness", "shipping_effectiveness_by_state"], "D46": ["unit_cost"],
    "D47": ["extended_cost"], "D48": ["full_cost"], "D49": ["incremental_capacity"],
    "D50": ["make_cost_breakdown"], "D51": ["make_vs_buy", "shared_capacity"],
    "D52": ["region_sales_net_of_returns", "state_revenue", "priority_by_customer"],
}

# Keys that SQL cannot express: tested against simulation and formulas instead (tests/test_lifetime.py).
WITHOUT_SQL = {"customer_lifetime_forecast"}
